"""Exact top-k by inner product without random access (NRA), over blocks of vectors.

A block keeps one sorted list per dimension. A query reads every list from its better end (from
the top where its weight is positive, from the bottom where it is negative). What has been read
of a vector gives bounds of its score: an unread entry is at best the list's frontier, at worst
the list's last value. Reading stops for a query when no more than a few vectors can still reach
its k-th lower bound; their scores are then resolved. Blocks' winners are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of each list that have been read after a round.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2)


def nra_block(
    queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the (positions, scores) of its best k vectors of the block, ties to smaller ids.

    ``own`` is each query's id, which is no candidate. All queries of the block read their lists
    in step, so the bounds of a round are four matrix products: an entry counts as read where it
    passes its list's frontier, and as the frontier (or the last value) where it does not.
    """
    n, dims = vectors.shape
    biggest = (np.abs(queries).max(initial=0.0), np.abs(vectors).max(initial=0.0))
    exact = biggest[0] * biggest[1] * max(dims, 1) < 2**53
    lists = np.sort(vectors, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    answers: list = [None] * len(queries)
    reading = np.arange(len(queries))
    slack = max(4 * k, n // 16)

    def resolve(q: int, candidates: np.ndarray) -> None:
        rows = vectors[candidates]
        scores = rows @ queries[q] if exact else rows.astype(np.int64) @ queries[q].astype(np.int64)
        best = np.lexsort((ids[candidates], -scores))[:k]
        answers[q] = (candidates[best], scores[best].astype(np.int64))

    for depth in DEPTHS if exact and n > 4 * k else ():
        if not len(reading):
            break
        read = max(1, int(n * depth))
        top, bottom = lists[n - read], lists[read - 1]
        a, b = up[reading], down[reading]
        upper = a @ np.minimum(vectors, lists[-1]).clip(min=top).T + b @ vectors.clip(max=bottom).T
        lower = a @ np.where(vectors >= top, vectors, lists[0]).T + b @ np.where(vectors <= bottom, vectors, lists[-1]).T
        self_ = own[reading][:, None] == ids[None, :]
        lower[self_] = -np.inf
        upper[self_] = -np.inf
        floor = np.partition(lower, n - k, axis=1)[:, n - k]
        alive = upper >= floor[:, None]
        done = (alive.sum(1) <= slack) & np.isfinite(floor)
        for i in np.flatnonzero(done):
            resolve(int(reading[i]), np.flatnonzero(alive[i]))
        reading = reading[~done]
    for q in reading:  # lists read to their ends
        resolve(int(q), np.flatnonzero(ids != own[q]))
    return answers


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where the vector has a bad component."""
    good = embedding.isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.when(good, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector",
    block: int = 1024, query_block: int = 4096,
) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` best rows by inner product, ties to smaller ids.

    Vectors are arrays of whole numbers. Rows with the query's id are no candidates for it.
    Rows with a null id or vector take no part. Equal (id, vector) rows are counted and come
    back as often as they occur (up to k); an id with several vectors is several candidates, and
    a query with several vectors uses the smallest. Vectors of different lengths are compared as
    if missing components were 0. With fewer than k candidates all come back; without
    candidates or queries there is no row.

    Every block of queries meets every block of rows, by a copy of the rows per query block and
    of the queries per row block; neither is collected. Blocks are hashes of the whole row, so a
    hot vector or id fills no block. Scores are exact up to 2**53, beyond in 64-bit whole numbers.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    base = base.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    asked = (
        queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
        .groupBy("id").agg(F.min("v").alias("v"))
    )
    n_rows, n_asked = rows.count(), queries.count()
    n_blocks, n_asked_blocks = max(1, -(-n_rows // block)), max(1, -(-n_asked // query_block))
    left = base.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int"))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked_blocks - 1))))
    right = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_asked_blocks)).cast("int"))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
        out = np.zeros((len(column), dims))
        flat = column.combine_chunks()
        lengths = np.diff(flat.offsets.to_numpy())
        values = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()]
        out[np.arange(dims)[None, :] < lengths[:, None]] = values
        return out

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        found: tuple[list, ...] = ([], [], [])
        if vectors.num_rows and questions.num_rows:
            dims = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (vectors, questions))
            ids, own = vectors.column("id").to_numpy(), questions.column("id").to_numpy()
            copies = vectors.column("copies").to_numpy()
            rows_ = np.repeat(matrix(vectors.column("v"), dims), copies, axis=0)
            ids = np.repeat(ids, copies)
            asked_ = matrix(questions.column("v"), dims)
            for start in range(0, len(asked_), 512):
                part = slice(start, start + 512)
                for q, (at, scores) in zip(own[part], nra_block(asked_[part], own[part], rows_, ids, k), strict=True):
                    found[0].append(np.full(len(at), q))
                    found[1].append(ids[at])
                    found[2].append(scores)
        columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in found]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "id", "score"])

    met = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(run, "query_id long, id long, score long")
    rank = F.expr("row_number() over (partition by query_id order by score desc, id)")
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
