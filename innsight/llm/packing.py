"""Packing token sequences into windows by non-negative least squares over a length histogram.

A document is cut at multiples of the window; a full window is a sequence of its own. What is
left over is packed by the histogram of its lengths alone: shallow combinations of lengths that
fill a window are enumerated, least squares with non-negative repeat counts fits them to the
histogram, the counts are rounded down, and lengths still open are packed greedily, again by
count. The plan is a short list of (combination, repeats) however many documents there are; a
piece finds its window from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.tokens import tokenizer
from innsight.llm.work import slices, stored


@dataclass(frozen=True)
class Combination:
    """Pieces per length class that share one sequence, and how many sequences are built so."""

    pieces: tuple[tuple[int, int], ...]
    repeats: int


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``depth`` classes that sum to ``classes`` exactly."""
    out: list[tuple[int, ...]] = []

    def extend(taken: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            out.append(taken)
        elif len(taken) < depth:
            # the rest has to fit into the places left, each of at most the next size
            for size in range(min(left, most), -(-left // (depth - len(taken))) - 1, -1):
                extend((*taken, size), left - size, size)

    extend((), classes, classes)
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises ``|matrix @ x - target|`` by accelerated projected gradient steps."""
    gram, right = matrix.T @ matrix, matrix.T @ target
    step = 1.0 / np.linalg.norm(matrix, 2) ** 2
    x = y = np.zeros(matrix.shape[1])
    t = 1.0
    for _ in range(rounds):
        following = np.maximum(0.0, y - step * (gram @ y - right))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = following + (t - 1) / t_next * (following - x)
        x, t = following, t_next
    return x


def plan(histogram: np.ndarray, depth: int = 3) -> list[Combination]:
    """Combinations with repeat counts that use every piece of the histogram exactly once.

    ``histogram[c]`` counts pieces of class c (1 to ``len - 1``, the last being a full window).
    """
    classes = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    found: list[Combination] = []

    def take(members: tuple[int, ...], repeats: int) -> None:
        sizes, counts = np.unique(members, return_counts=True)
        left[sizes] -= counts * repeats
        found.append(Combination(tuple(zip(sizes.tolist(), counts.tolist(), strict=True)), repeats))

    shallow = [c for c in combinations(classes, depth) if all(left[s] for s in c)]
    if shallow:
        matrix = np.zeros((classes + 1, len(shallow)))
        for j, members in enumerate(shallow):
            for size in members:
                matrix[size, j] += 1
        repeats = np.floor(nnls(matrix, left.astype(float)) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            sizes, counts = np.unique(shallow[j], return_counts=True)
            most = min(int(repeats[j]), int((left[sizes] // counts).min()))
            if most > 0:
                take(shallow[j], most)
    # residuals: fill a window with the largest class that fits, as often as the counts allow
    while left.any():
        room, members = classes, []
        used = np.zeros_like(left)
        while room:
            fits = np.flatnonzero((left[: room + 1] - used[: room + 1]) > 0)
            if not len(fits):
                break
            size = int(fits[-1])
            members.append(size)
            used[size] += 1
            room -= size
        sizes = np.flatnonzero(used)
        take(tuple(members), int((left[sizes] // used[sizes]).min()))
    return found


def cut_documents(
    docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    ids: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) per piece; row-local.

    A null text counts as empty: its only id is ``end_id``. ``ids`` holds little-endian
    unsigned 32-bit ids; left out, they never leave the task's Python.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_column
        last = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", 2_000_000):
            columns: tuple[list, ...] = tuple([] for _ in names)
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                whole = found.astype("<u4").tobytes() + last
                total = len(whole) // 4
                for start in range(0, total, window):
                    piece = whole[4 * start : 4 * (start + window)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece)
                    for column, value in zip(columns, row):  # without ids the piece itself is dropped
                        column.append(value)
            kinds = (*(pa.int64(),) * 5, pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])]
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return base.mapInArrow(run, kinds + (", ids binary" if ids else ""))


def pack(pieces: DataFrame, window: int = 2048, grain: int = 16, depth: int = 3, buckets: int = 64) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` needs ``doc_id``, ``start`` and ``length`` (1 to ``window``). Lengths are rounded
    up to classes of ``grain``; full windows are a class whose combination is itself. Offsets
    use true lengths, so they are gapless from 0 and only a sequence's end is padded. Ranks are
    counted in ``buckets`` parts of each class by a hash of the piece, so that a class holding
    most pieces is no single task; per part one number reaches the driver (at most
    ``window / grain * buckets``). Repeated rows are pieces of their own; their order among
    each other does not matter. An empty table gives an empty result.
    """
    classes = -(-window // grain)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(
        *names,
        F.expr(f"cast(ceil(length / {grain}) as int)").alias("_class"),
        F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int").alias("_part"),
    )
    counts = np.zeros((classes + 1, buckets), np.int64)
    for r in rows.groupBy("_class", "_part").agg(F.count("*").alias("n")).collect():
        counts[r["_class"], r["_part"]] = r["n"]
    combos = plan(counts.sum(1), depth)
    before = np.cumsum(counts, axis=1) - counts

    # per class: from which rank on a combination uses it, how many a sequence, first sequence
    uses: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = np.zeros(classes + 1, np.int64)
    sequence = 0
    for combo in combos:
        for size, count in combo.pieces:
            uses.setdefault(size, []).append((int(taken[size]), count, sequence))
            taken[size] += count * combo.repeats
        sequence += combo.repeats
    tables = {size: tuple(np.array(x, np.int64) for x in zip(*rows_, strict=True)) for size, rows_ in uses.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("_class").to_numpy()
            rank = batch.column("_rank").to_numpy() - 1 + before[size, batch.column("_part").to_numpy()]
            found = np.zeros(len(size), np.int64)
            for c in np.unique(size):
                here = size == c
                starts, each, first = tables[int(c)]
                at = np.searchsorted(starts, rank[here], "right") - 1
                found[here] = first[at] + (rank[here] - starts[at]) // each[at]
            yield pa.record_batch(
                [*(batch.column(n) for n in names), pa.array(found)], names=[*names, "sequence_id"]
            )

    ranked = rows.withColumn("_rank", F.expr("row_number() over (partition by _class, _part order by doc_id, start)"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    placed = ranked.mapInArrow(place, f"{schema}, sequence_id long")
    order = "partition by sequence_id order by length desc, doc_id, start rows between unbounded preceding and 1 preceding"
    return placed.withColumn("offset", F.expr(f"coalesce(sum(length) over ({order}), 0L)"))


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, grain: int = 16, ids: bool = False) -> DataFrame:
    """Packed pieces of documents; the cut pieces are stored once, with their ids if asked for.

    Columns other than ``doc_id`` and ``text`` are not read.
    """
    return pack(stored(cut_documents(docs, vocabulary, window, ids=ids), "pieces"), window, grain)
