"""Sharding along a Hilbert curve: rows near in several metadata dimensions share a shard.

Each dimension is quantised at its own quantiles, the cells are numbered along a Hilbert curve,
rows are ordered by that number, and the order is cut into runs of equal row counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

_TIE_BITS = 44


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of integer points, one row each, with ``bits`` bits a dimension.

    Skilling's transform (Programming the Hilbert curve, 2004): undo the excess rotations from
    the top bit down, Gray-decode, and interleave the bits of the transposed index.
    """
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(x[i] & q, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _ordinals(df: DataFrame, dimensions: list[str]) -> list[Column]:
    """Order-preserving numbers; for texts the seven bytes that follow their common beginning."""
    texts = [c for c in dimensions if not isinstance(df.schema[c].dataType, NumericType)]
    ends = {}
    if texts:
        row = df.agg(*[f(F.col(f"`{c}`").cast("string")).alias(f"{n}{i}")
                       for i, c in enumerate(texts) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for i, c in enumerate(texts):
            low, high = (row[f"{n}{i}"] or "" for n in ("lo", "hi"))
            low, high = low.encode(), high.encode()
            ends[c] = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    out = []
    for c in dimensions:
        column = F.col(f"`{c}`")
        if c in ends:
            tail = F.substring(F.encode(column.cast("string"), "UTF-8"), ends[c] + 1, 7)
            out.append(F.conv(F.rpad(F.hex(tail), 14, "0"), 16, 10).cast("double"))
        else:
            out.append(column.cast("double"))
    return out


def curve_position(df: DataFrame, dimensions: list[str], bits: int = 5) -> Column:
    """The Hilbert index of a row's cell; nulls and NaN lie in the first cell of a dimension.

    Cuts are quantiles over all rows, so a crowded value takes a cell and not the whole curve.
    """
    numbers = _ordinals(df, dimensions)
    parts = 1 << bits
    shares = [k / parts for k in range(1, parts)]
    finite = [F.when(~F.isnan(n), n) for n in numbers]
    row = df.agg(*[F.percentile_approx(n, shares, 10_000).alias(f"c{i}") for i, n in enumerate(finite)]).first()
    cells = []
    for i, n in enumerate(finite):
        cuts = sorted(set(row[f"c{i}"] or []))
        cell = F.lit(0)
        for cut in cuts:
            cell = cell + F.when(n >= cut, 1).otherwise(0)
        cells.append(cell.cast("int"))

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return place(*cells)


def assign_shards(
    df: DataFrame, shards: int, dimensions: list[str], id_col: str = "doc_id", bits: int = 5, buckets: int = 256
) -> DataFrame:
    """All columns of ``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0).

    Row counts of shards differ by at most one. Rows are ordered by Hilbert index, then by a
    hash of the id and the id. The global position of a row is its rank in one of ``buckets``
    runs of that order plus the rows of the runs before; only the runs' cuts and counts reach
    the driver. Rows that are equal in the order (repeated ids) may take each other's places.
    Null ids and null dimensions sort first. An empty table gives an empty result, a table
    smaller than ``shards`` leaves shards empty. Existing columns of the result's names are
    replaced.
    """
    df = df.drop(*[c for c in ("shard", "slot") if c in df.columns and c != id_col])
    tie = F.xxhash64(F.col(f"`{id_col}`")).bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    key = F.shiftleft(curve_position(df, dimensions, bits), _TIE_BITS).bitwiseOR(tie)
    kept = df.columns
    keyed = df.withColumn("_key", key)
    shares = [k / buckets for k in range(1, buckets)]
    cuts = keyed.agg(F.percentile_approx("_key", shares, 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    run = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_key"))) if cuts else F.lit(0)
    keyed = keyed.withColumn("_run", run)
    counts = {r["_run"]: r["n"] for r in keyed.groupBy("_run").agg(F.count("*").alias("n")).collect()}
    total, before = 0, []
    for k in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(k, 0)
    # row_number over the run; the window is partitioned by run and sorts rows without their texts only if the caller's select drops them
    rank = F.expr("row_number() over (partition by _run order by _key, `{0}`)".format(id_col))
    position = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_run") + 1) + rank - 1
    placed = keyed.withColumn("_position", position)
    shard = F.expr(f"(_position * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("_position") - first)
        .withColumn("shard", F.col("shard").cast("int"))
        .select(*[F.col(f"`{c}`") for c in kept], "shard", "slot")
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """Shards as folders ``shard=k``, each sorted by slot, so files hold narrow value ranges."""
    assigned.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
