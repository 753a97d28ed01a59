"""Approximate vector search over a stored index of random projections.

Each of several tables cuts the space by random hyperplanes; the sides a vector lies on are its
bucket there. The index holds every vector once per table, sorted by table and bucket, so a
search reads the buckets it probes and scores them where they are. A query probes, beside its
own bucket, those that are reached by crossing the hyperplanes nearest to it. What is found is
scored exactly; what is in no probed bucket is missed. The exact search is
``retrieval.search_top_k`` and stays the default.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innsight.functions import vectors
from innsight.operators import metric_index
from innsight.operators.topics import flatten_vectors

TABLES, BITS, PROBES, SEED = 8, 8, 24, 1
#: Folders per table: buckets share a folder by their first bits.
_SHELF_BITS = 3


def hyperplanes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Normals of all tables' hyperplanes, the same for the same parameters."""
    return np.random.default_rng(seed).normal(size=(tables * bits, dims))


def _sides(matrix: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets by row and table, distances by row, table and hyperplane)."""
    away = (matrix @ planes.T).reshape(len(matrix), tables, bits)
    return (away > 0) @ (1 << np.arange(bits, dtype=np.int64)), away


def probed(matrix: np.ndarray, planes: np.ndarray, tables: int, bits: int, probes: int) -> np.ndarray:
    """Buckets by row, table and probe: the own one first, then by the distance crossed.

    The cost of a bucket is the sum of squared distances to the hyperplanes between.
    """
    own, away = _sides(matrix, planes, tables, bits)
    flips = np.arange(1 << bits)
    crossed = (flips[:, None] >> np.arange(bits) & 1).astype(float)
    cost = (away**2) @ crossed.T
    order = np.argsort(cost, axis=2, kind="stable")[:, :, : min(probes, 1 << bits)]
    return own[:, :, None] ^ order


def _usable(df: DataFrame, id_col: str, vector_col: str, keys: Sequence[str], dims: int | None) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("string").alias("id"), vector.alias("vec"), *[F.col(c).cast("string").alias(c) for c in keys])
    rows = rows.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)) & (vectors.l2_norm(F.col("vec")) > 0))
    rows = rows.dropna(subset=list(keys)) if keys else rows
    return rows if dims is None else rows.where(F.size("vec") == dims)


def write_index(
    corpus: DataFrame, path: str, match_on: Sequence[str] = (), *, tables: int = TABLES, bits: int = BITS, seed: int = SEED,
    id_col: str = "doc_id", vector_col: str = "vector",
) -> None:
    """Write the index of a corpus; ``match_on`` names columns a search may ask to be equal.

    Rows without an id, with a null, zero or non-finite vector, or with a null in ``match_on`` are
    left out. All vectors have the length of the longest. Files are cut by table, bucket and a
    hash of the id, so a bucket with a third of all vectors is many files.
    """
    spark = corpus.sparkSession
    rows = _usable(corpus, id_col, vector_col, match_on, None).where("id is not null")
    dims = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    planes = hyperplanes(dims, tables, bits, seed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                buckets, _ = _sides(flatten_vectors(batch.column(batch.schema.get_field_index("vec"))), planes, tables, bits)
                of = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(buckets.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, of], names=[*batch.schema.names, "buckets"])

    kinds = ", ".join(["id string", "vec array<double>", *[f"`{c}` string" for c in match_on], "buckets array<long>"])
    placed = rows.where(F.size("vec") == dims).mapInArrow(work, kinds).select(
        "id", "vec", *match_on, F.posexplode("buckets").alias("table", "bucket")
    )
    shelf = F.col("table") * (1 << _SHELF_BITS) + F.shiftright(F.col("bucket"), max(0, bits - _SHELF_BITS)).cast("int")
    ordered = placed.withColumn("shelf", shelf).repartitionByRange("shelf", "bucket", F.xxhash64("id")).sortWithinPartitions("shelf", "bucket")
    ordered.write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/buckets")
    meta = spark.createDataFrame(
        [(dims, tables, bits, seed, list(match_on))], "dims int, tables int, bits int, seed long, match_on array<string>"
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def search_index(
    queries: DataFrame, path: str, k: int = 10, *, probes: int = PROBES, block_rows: int = 4096, vector_col: str = "vector"
) -> DataFrame:
    """About the ``k`` most similar documents per query: ``(query_id, doc_id, similarity, rank)``.

    ``queries`` holds ``query_id``, a vector and the columns the index matches on. Similarities
    are exact; ties go to the smaller id. More probes find more; with ``2 ** bits`` of them the
    search is exact. Queries may be many: they are dealt to the buckets in blocks, and buckets
    that no query probes are not read where folders and row groups tell them apart.
    """
    spark = queries.sparkSession
    meta = spark.read.parquet(f"{path}/meta").first()
    dims, tables, bits, keys = meta["dims"], meta["tables"], meta["bits"], list(meta["match_on"])
    planes = hyperplanes(dims, tables, bits, meta["seed"])
    asked = _usable(queries, "query_id", vector_col, keys, dims)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                buckets = probed(flatten_vectors(batch.column(batch.schema.get_field_index("vec"))), planes, tables, bits, probes)
                n = tables * buckets.shape[2]
                codes = (np.arange(tables)[None, :, None] << bits) + buckets
                of = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, of], names=[*batch.schema.names, "codes"])

    kinds = ", ".join(["id string", "vec array<double>", *[f"`{c}` string" for c in keys], "codes array<long>"])
    spread = asked.mapInArrow(work, kinds).select("id", "vec", *keys, F.explode("codes").alias("code"))
    table, bucket = F.shiftright("code", bits).cast("int"), F.col("code").bitwiseAND(F.lit((1 << bits) - 1))
    shelf = table * (1 << _SHELF_BITS) + F.shiftright(bucket, max(0, bits - _SHELF_BITS)).cast("int")
    spread = spread.withColumns({"shelf": shelf, "table": table, "bucket": bucket})
    kinds = ", ".join(["id string", "vec array<double>", *[f"`{c}` string" for c in keys], "table int, bucket long, shelf int"])
    index = spark.read.schema(kinds).parquet(f"{path}/buckets")
    wanted = spread.select("shelf", "table", "bucket").distinct()
    met = index.join(wanted, ["shelf", "table", "bucket"], "left_semi")

    def keyed(df: DataFrame) -> DataFrame:
        key = F.concat_ws(":", F.col("table").cast("string"), F.col("bucket").cast("string"), *[F.col(c) for c in keys])
        return df.select(key.alias("key"), "id", "vec")

    known = keyed(met)
    subs = known.groupBy("key").agg(metric_index._parts(F.count("*"), block_rows).alias("subs"))
    known = known.join(subs, "key").select("key", metric_index._share("id", F.col("subs"), "sub").alias("sub"), "id", "vec")
    dealt = keyed(spread).join(subs, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "id", "vec")
    found = metric_index.met_in_blocks(dealt, known, ["key", "sub"], k, block_rows, not_itself=False)
    # a document met in several tables counts once
    once = found.groupBy(F.col("id").alias("query_id"), F.col("near_id").alias("doc_id")).agg(F.max("similarity").alias("similarity"))
    window = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return once.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, asked, met, recall)``: how many of the exact results an approximate search met."""
    met = found.select("query_id", "doc_id", F.lit(1).alias("_met"))
    rows = exact.select("query_id", "doc_id").join(met, ["query_id", "doc_id"], "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("asked"), F.count("_met").alias("met")).withColumn(
        "recall", F.col("met") / F.col("asked")
    )
