"""Helpers of the operators here: scratch tables, bounded filters, components, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.sources.shared import shared_folder

_U = np.uint64


def stored(df: DataFrame, name: str, compression: str | None = None, level: int = 3) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends in files all can read.

    ``level`` is that of zstd.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("parquet.compression.codec.zstd.level", level).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a text column holds about ``max_bytes`` at once; no row is split."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def within(df: DataFrame, column: str, ids: DataFrame, id_column: str, bits: int = 1 << 23) -> DataFrame:
    """Rows whose id may be among ``ids``: a fixed-size bit table keeps others from being shuffled.

    The table has ``bits`` bits however many ids there are, so broadcasting it is bounded. It
    lets through every wanted row and some others; a join on the id has to follow.
    """
    place = F.pmod(F.xxhash64(id_column), F.lit(bits))
    words = (
        ids.where(F.col(id_column).isNotNull())
        .select(place.alias("_p"))
        .groupBy(F.shiftright("_p", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_bits"))
    )
    own = F.pmod(F.xxhash64(column), F.lit(bits))
    return (
        df.withColumn("_place", own)
        .join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"), "inner")
        .where(F.expr("shiftright(_bits, cast(_place % 64 as int)) & 1L") == 1)
        .drop("_place", "_word", "_bits")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable from each node of an edge list.

    Labels spread along edges as minima (summed up before they are shuffled) and then jump to
    the label of their label. Every round ends in a table of the shared folder.
    """
    both = stored(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .where("u != v").distinct(),
        "edges",
    )
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("label").alias("near"))
        met = labels.join(near, labels.node == near.v, "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        further = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        jumped = met.join(further, met.label == further.n2, "left").select(
            "node", "old", F.least("label", "l2").alias("label")
        )
        found = stored(jumped, "labels")
        changed = found.where("label != old").limit(1).count()
        labels = found.select("node", "label")
        if not changed:
            return labels


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
