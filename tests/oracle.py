"""Side-by-side run of a registered query on Spark and its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float", "SMALLINT": "smallint",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        # the sign of a zero counts as well: values may be compared by their text
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(df, con, sql: str) -> str | None:
    """None when both give the same columns, types and rows; else what differs."""
    cursor = con.execute(sql)
    columns = [(c[0], str(c[1])) for c in cursor.description]
    expected_rows = cursor.fetchall()
    names = sorted(c for c, _ in columns)
    if names != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} sql {names}"
    kinds = {c: _KINDS.get(k.upper(), k) for c, k in columns}
    spark_kinds = dict(df.dtypes)
    wrong = {
        c: (spark_kinds[c], kinds[c])
        for c in names
        if spark_kinds[c].removesuffix("_ntz") != kinds[c]
    }
    position = {c: i for i, (c, _) in enumerate(columns)}
    expected = Counter(tuple(_plain(r[position[c]]) for c in names) for r in expected_rows)
    actual = Counter(tuple(_plain(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect())
    if expected != actual:
        only_spark = list((actual - expected).items())[:3]
        only_sql = list((expected - actual).items())[:3]
        return (
            f"rows: spark {sum(actual.values())} sql {sum(expected.values())}\n"
            f"  columns {names}\n  only spark {only_spark}\n  only sql {only_sql}"
        )
    if wrong:
        return f"types (spark, sql): {wrong}"
    return None
