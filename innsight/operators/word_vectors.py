"""Word and sentence vectors learnt from the corpus itself.

Words that occur near each other are counted, counts become positive pointwise mutual information
(PPMI), and the symmetric PPMI matrix is factorised by randomised subspace iteration: each round
multiplies blocks of word pairs by the vectors that a block needs. Only the ``dims x dims``
products of the vectors reach the driver. A sentence is the mean of its words, rare ones weighing
more; sentences meet vectors in chunks, so that a word's vector travels once a chunk.

Texts split by ``split_texts`` are cut into words once. Every chunk of them numbers its own words,
so that what is stored and shuffled later are small numbers in packed blobs; so are pairs of words,
by blocks, and the vectors of the fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from innsight.operators.topics import flatten_vectors
from innsight.sources.shared import discarded, stored

TOKEN = r"[\p{L}\p{N}_]+"
#: Pairs of a block on average, words whose vectors it holds, and bits of the number of texts in a chunk.
BLOCK_PAIRS, BLOCK_WORDS, CHUNK_BITS = 3_000_000, 1 << 17, 17
#: Numbers of vectors that are gathered at once, about what a core's cache holds, and numbers of a row for which it is added up alone.
GATHERED, LONG_ROW = 1 << 17, 128
#: Of split texts: rows of a blob, words of a chunk, and words of the chunks that share vectors.
BLOB_ROWS, CHUNK_WORDS, GROUP_WORDS = 1024, 1 << 22, 1 << 25
#: Of pairs of split texts: words of a piece (16 bits number them), places of a block on average,
#: places that a task holds, pairs of a blob, words whose sums a task holds, vectors of a blob.
PIECE_WORDS, BLOCK_PLACES, PLACES_HELD, BLOB_PAIRS, PART_WORDS, BLOB_VECTORS = 1 << 16, 1 << 22, 1_000_000, 1 << 19, 1 << 18, 2048
#: Rows of an Arrow batch where rows are blobs, and words that are few enough to be sent to every task.
BLOB_BATCH, FEW_WORDS = 8, 10_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed: high bytes, mostly zero, take no room."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return _compressed(planes.ravel())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    plain = _expanded(blob)
    planes = (np.frombuffer(plain, np.uint8) if plain.size else np.zeros(0, np.uint8)).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _compressed(plain) -> bytes:
    plain = pa.py_buffer(plain)
    return plain.size.to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _expanded(blob: bytes) -> pa.Buffer:
    return pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd")


@dataclass(frozen=True)
class SplitTexts:
    """Stored texts, cut into words: blobs of rows, and the words that each chunk numbers.

    ``chunks`` holds ``(chunk, rows, sizes, ids)`` for up to ``BLOB_ROWS`` texts: their kept columns,
    how many words each has, and the words' numbers. ``words`` holds ``(chunk, word, local, n)``.
    """

    chunks: DataFrame
    words: DataFrame
    schema: StructType


def _splitter(chunk_words: int, blob_rows: int, marks: Sequence[Sequence[str]] = ()) -> Callable:
    """Arrow function: batches whose last column is a list of words become blobs and numbered words."""
    bits: dict[str, int] = {}
    for k, words in enumerate(marks):
        for word in words:
            bits[word] = bits.get(word, 0) | 1 << k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk: int, rows=None, sizes=None, ids=None, word=None, local=None, n=None) -> pa.RecordBatch:
            given = (rows, sizes, ids, word, local, n)
            length = next(len(x) for x in given if x is not None)
            columns = [pa.array(np.full(length, chunk), pa.int64())]
            for x, kind in zip(given, (pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64()), strict=True):
                columns.append(pa.nulls(length, kind) if x is None else pa.array(x, kind))
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "rows", "sizes", "ids", "word", "local", "n"])

        chunk, known, n, held = TaskContext.get().partitionId() << 32, {}, np.zeros(0, np.int64), 0

        def ended() -> Iterator[pa.RecordBatch]:
            names = list(known)
            for start in range(0, len(names), 10_000):
                part = slice(start, start + 10_000)
                yield out(chunk, word=names[part], local=np.arange(start, start + len(names[part])), n=n[part])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = pc.dictionary_encode(lists.flatten())
            words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))[place]
            more = np.bincount(ids, minlength=len(known))
            more[: len(n)] += n
            n, held = more, held + len(ids)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            if marks:
                bit = np.fromiter((bits.get(w, 0) for w in words), np.int64, len(words))[place]
                marked, has = np.zeros(batch.num_rows, np.int64), np.flatnonzero(bit)
                np.bitwise_or.at(marked, np.repeat(np.arange(len(sizes)), sizes)[has], bit[has])
                kept = pa.RecordBatch.from_arrays([*kept.columns, pa.array(marked)], names=[*kept.schema.names, "marks"])
            blobs = []
            for start in range(0, batch.num_rows, blob_rows):
                stop = min(start + blob_rows, batch.num_rows)
                rows = _compressed(kept.slice(start, stop - start).serialize())
                blobs.append((rows, _packed(sizes[start:stop].astype("<u4")), _packed(ids[ends[start] : ends[stop]].astype("<u4"))))
            yield out(chunk, *map(list, zip(*blobs, strict=True)))
            if held >= chunk_words:
                yield from ended()
                chunk, known, n, held = chunk + 1, {}, np.zeros(0, np.int64), 0
        yield from ended()

    return work


def split_texts(
    texts: DataFrame, keep: Sequence[str], text_col: str = "sentence_text", marks: Sequence[Sequence[str]] = ()
) -> SplitTexts:
    """Texts cut into words, once, and stored with the columns in ``keep``; the operators here take them as texts.

    Of up to 63 lists of words in ``marks``, bit k of the column ``marks`` tells whether a text has a word of the k-th.
    """
    if len(marks) > 63:
        raise ValueError(f"marks: {len(marks)} lists, more than 63")
    given = texts.select(*keep, words_of(F.col(text_col)).alias("_words"))
    kinds = "chunk long, rows binary, sizes binary, ids binary, word string, local int, n long"
    held = stored(given.mapInArrow(_splitter(CHUNK_WORDS, BLOB_ROWS, marks), kinds), "split-texts", compression="zstd")
    return SplitTexts(
        held.where("ids is not null").select("chunk", "rows", "sizes", "ids"),
        held.where("word is not null").select("chunk", "word", "local", "n"),
        StructType([*(texts.schema[c] for c in keep), *([StructField("marks", LongType())] if marks else [])]),
    )


def word_counts(texts: DataFrame | SplitTexts, text_col: str = "sentence_text", min_count: int = 5) -> DataFrame:
    """``(word, n)`` of the words that occur at least ``min_count`` times."""
    if isinstance(texts, SplitTexts):
        counts = texts.words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        return stored(counts, "word-counts")
    return texts.select(F.explode(words_of(F.col(text_col))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")
    ).where(F.col("n") >= min_count)


def _coded_pairs(texts: DataFrame, known: DataFrame, text_col: str, window: int) -> DataFrame:
    """``(a, b, n)``: how often two numbered words stand within ``window`` words, each pair one way.

    Words meet their numbers one by one and come back to their text, so that what is counted and
    shuffled are pairs of numbers, of words that are known.
    """
    split = stored(texts.select(words_of(F.col(text_col)).alias("words")), "words")
    # numbered before they are cut up; read from files, a row gets the same number again
    places = split.withColumn("row", F.monotonically_increasing_id()).select("row", F.posexplode("words").alias("pos", "word"))
    coded = places.join(known, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("words"))

    def later(x: Column, i: Column) -> Column:
        near = F.filter(F.slice("words", i + 2, window), lambda y: (y["pos"] - x["pos"] <= window) & (y["id"] != x["id"]))
        return F.transform(near, lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")))

    return coded.select(F.inline(F.flatten(F.transform("words", later)))).groupBy("a", "b").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class BlockedPairs:
    """Stored counts of pairs of split texts' words, each pair one way, in blocks.

    Word ``id`` is number ``id // pieces`` of piece ``id % pieces``. ``blocks`` holds ``(a, b, low, n)``:
    two pieces, a blob of ascending numbers ``of a << 16 | of b`` as differences, and how often
    each pair stands near. ``sums`` holds ``(piece, of)``, the words' sums of ``n``, whose sum is ``total``.
    With ``weighed`` the value of a pair is its PPMI, and pairs without one are left out.
    """

    names: DataFrame
    blocks: DataFrame
    sums: DataFrame
    words: int
    pieces: int
    total: int
    weighed: bool = False

    def values(self) -> Callable:
        total, weighed = float(self.total), self.weighed

        def of(n: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
            return np.log(n * total / (of_a * of_b)) if weighed else n.astype(float)

        return of


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """Stored ``(word, id)`` with the numbers from 0 on, frequent words first in each task, and how many."""
    by = [F.desc("n")] if "n" in words.columns else ["word"]
    placed = stored(words.sortWithinPartitions(*by).select("word", F.monotonically_increasing_id().alias("_at")), "vocabulary")
    task = F.shiftright("_at", 33).cast("int")
    sizes = {r["task"]: r["n"] for r in placed.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()}  # a number a task
    before, offsets = 0, []
    for k in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(k, 0)
    first = F.element_at(F.lit(np.array(offsets or [0], dtype=np.int64)), task + 1)
    return placed.select("word", (first + F.expr("_at & 8589934591L")).alias("id")), before


def _blobs(keys: np.ndarray, n: np.ndarray, most: int | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """Ascending ``block << 32 | low`` and their numbers as blobs, of one block each."""
    block = (keys >> np.uint64(32)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        for start in range(first, last, most or max(1, last - first)):
            part = slice(start, min(last, start + most) if most else last)
            low = (keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield int(block[start]), _packed(np.diff(low, prepend=np.uint32(0))), _packed(n[part].astype(np.uint64))


def _low(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob, "<u4"), dtype=np.uint32)


def _near(pieces: int, window: int, most: int) -> Callable:
    """Arrow function of a chunk's blobs and its known words: how often known words stand near, by block."""

    def counted(held: list[np.ndarray]) -> Iterator[tuple[int, bytes, bytes]]:
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return _blobs(keys[first], np.diff(first, append=len(keys)))

    def work(texts: pa.Table, known: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[bytes, bytes]]] = {}
        held: list[np.ndarray] = []

        def put() -> None:
            for block, low, n in counted(held):
                found.setdefault(block, []).append((low, n))

        if texts.num_rows and known.num_rows:
            code = np.full(pc.max(known["local"]).as_py() + 1, -1, np.int64)
            number = known["id"].to_numpy()
            code[known["local"].to_numpy()] = (number % pieces) << 16 | number // pieces
            places = 0
            for ids, sizes in zip(texts["ids"], texts["sizes"], strict=True):
                # no text goes on in the next blob
                ids, sizes = _unpacked(ids.as_buffer(), "<u4"), _unpacked(sizes.as_buffer(), "<u4")
                row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                each = np.where(ids < len(code), code[np.minimum(ids, len(code) - 1)], -1)
                for k in range(1, window + 1):
                    x, y = each[:-k], each[k:]
                    good = np.flatnonzero((row[:-k] == row[k:]) & (x >= 0) & (y >= 0) & (x != y))
                    low, high = np.minimum(x, y)[good], np.maximum(x, y)[good]
                    block = (low >> 16) * pieces + (high >> 16)
                    held.append((block << 32 | (low & 0xFFFF) << 16 | (high & 0xFFFF)).astype(np.uint64))
                    places += len(low)
                if places >= most:
                    put()
                    places = 0
            if places:
                put()
        merged = []
        for block in list(found):
            blobs = found.pop(block)
            if len(blobs) > 1:
                keys, n = _joined(blobs)
                blobs = [(low, times) for _, low, times in _blobs(keys, n)]
            merged.extend((block, *blob) for blob in blobs)
        block, low, n = zip(*merged, strict=True) if merged else ((), (), ())
        return pa.table({"block": pa.array(block, pa.int64()), "low": pa.array(low, pa.binary()), "n": pa.array(n, pa.binary())})

    return work


def _joined(blobs: Sequence[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block's blobs, ascending and once each, and the sums of their numbers."""
    counts = [_unpacked(n, "<u8") for _, n in blobs]
    keys, filled = np.empty(sum(map(len, counts)), np.uint64), 0
    for k, (low, _) in enumerate(blobs):
        part = keys[filled : filled + len(counts[k])]
        part[:] = _low(low)
        part <<= np.uint64(32)
        part |= counts[k]
        filled, counts[k] = filled + len(part), None
    keys.sort()
    n = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys >>= np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _merge(pieces: int, most: int) -> Callable:
    """Arrow function of a block's blobs: its pairs once each, and the sums of the words of its pieces."""

    def work(blobs: pa.Table) -> pa.Table:
        block = blobs["block"][0].as_py()
        a, b = divmod(block, pieces)
        keys, n = _joined([(low.as_buffer(), times.as_buffer()) for low, times in zip(blobs["low"], blobs["n"], strict=True)])
        rows = [(a, b, low, times) for _, low, times in _blobs(keys, n, most)]
        for piece, number in ((a, keys >> np.uint64(16)), (b, keys & np.uint64(0xFFFF))):
            rows.append((piece, None, None, _packed(np.bincount(number.astype(np.int64), weights=n).astype(np.uint64))))
        kinds = (("a", pa.int32()), ("b", pa.int32()), ("low", pa.binary()), ("n", pa.binary()))
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds, zip(*rows, strict=True), strict=True)})

    return work


def _added(rows: pa.Table) -> pa.Table:
    """The sums of one piece from those of its blocks."""
    parts = [_unpacked(x.as_buffer(), "<u8") for x in rows["n"]]
    whole = np.zeros(max(map(len, parts)), np.uint64)
    for x in parts:
        whole[: len(x)] += x
    return pa.table({"piece": pa.array([rows["a"][0].as_py()], pa.int32()), "of": pa.array([_packed(whole)], pa.binary()), "total": pa.array([int(whole.sum())], pa.int64())})


def _blocked_pairs(texts: SplitTexts, vocabulary: DataFrame, window: int) -> BlockedPairs:
    """Pairs are summed up per chunk and come to their block as packed blobs, where they are merged."""
    given = ["word", "n"] if "n" in vocabulary.columns else ["word"]
    names, words = _numbered(vocabulary.select(*given).dropDuplicates(["word"]).where("word is not null"))
    of_chunks = stored(texts.words.join(names, "word").select("chunk", "local", "id", "n"), "known-words", compression="zstd")
    places = (of_chunks.agg(F.sum("n")).first()[0] or 0) * window  # one number, at least as many as there are
    pieces = max(1, math.ceil(words / PIECE_WORDS), math.ceil(math.sqrt(2 * places / BLOCK_PLACES)))
    blobs = texts.chunks.select("chunk", "sizes", "ids").groupBy("chunk").cogroup(of_chunks.select(F.col("chunk").alias("_of"), "local", "id").groupBy("_of"))
    near = stored(blobs.applyInArrow(_near(pieces, window, PLACES_HELD), "block long, low binary, n binary"), "chunk-pairs")
    held = stored(near.groupBy("block").applyInArrow(_merge(pieces, BLOB_PAIRS), "a int, b int, low binary, n binary"), "pair-counts")
    discarded(near)
    discarded(of_chunks)
    sums = stored(held.where("b is null").select("a", "n").groupBy("a").applyInArrow(_added, "piece int, of binary, total long"), "paired-words")
    total = sums.agg(F.sum("total")).first()[0] or 0  # one number
    return BlockedPairs(names, held.where("b is not null"), sums.select("piece", "of"), words, pieces, total)


def pair_counts(
    texts: DataFrame | SplitTexts, vocabulary: DataFrame, text_col: str = "sentence_text", window: int = 5
) -> DataFrame | BlockedPairs:
    """``(word, context, n)``: how often two different words stand within ``window`` words, both ways.

    ``of_word``, ``of_context`` and ``of_all`` are the sums of ``n`` over the pairs of either word and
    over all pairs. Pairs are counted once per place and summed up within each task before they
    are shuffled; they are counted once, however often the result is read. Of split texts the
    same pairs come in blocks.
    """
    if isinstance(texts, SplitTexts):
        return _blocked_pairs(texts, vocabulary, window)
    known = stored(vocabulary.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    counted = stored(_coded_pairs(texts, known, text_col, window), "pair-counts")
    sides = F.array(F.struct(F.col("a").alias("id"), "n"), F.struct(F.col("b").alias("id"), "n"))
    of = counted.select(F.inline(sides)).groupBy("id").agg(F.sum("n").alias("of"))
    names = stored(known.join(of, "id"), "paired-words")
    total = names.agg(F.sum("of")).first()[0] or 0  # one number

    def side(key: str) -> DataFrame:
        return names.select(F.col("id").alias(key), F.struct("word", "of").alias(f"{key}_word"))

    named = counted.join(side("a"), "a").join(side("b"), "b")
    both = F.array(*[
        F.struct(
            F.col(f"{x}_word.word").alias("word"), F.col(f"{y}_word.word").alias("context"), "n",
            F.col(f"{x}_word.of").alias("of_word"), F.col(f"{y}_word.of").alias("of_context"),
        )
        for x, y in ("ab", "ba")
    ])
    return named.select(F.inline(both)).withColumn("of_all", F.lit(total).cast("long"))


def _with_sums(pairs: DataFrame) -> DataFrame:
    """Pairs from elsewhere with the sums that ``pair_counts`` gives."""
    marginal = pairs.groupBy("word").agg(F.sum("n").alias("of"))
    total = pairs.agg(F.sum("n")).first()[0] or 0  # one number
    sized = pairs.join(marginal.withColumnRenamed("of", "of_word"), "word").join(
        marginal.select(F.col("word").alias("context"), F.col("of").alias("of_context")), "context"
    )
    return sized.withColumn("of_all", F.lit(total))


def ppmi(pairs: DataFrame | BlockedPairs) -> DataFrame | BlockedPairs:
    """``(word, context, n, ppmi)`` of the pairs that meet more often than chance has it.

    Sums that the pairs carry, as those of ``pair_counts`` do, are taken as they are. Those of
    blocks are weighed where a block is read, which takes less than to store and to shuffle them.
    """
    if isinstance(pairs, BlockedPairs):
        return replace(pairs, weighed=True)
    sized = pairs if {"of_word", "of_context", "of_all"} <= set(pairs.columns) else _with_sums(pairs)
    value = F.log(F.col("n").cast("double") * F.col("of_all").cast("double") / (F.col("of_word").cast("double") * F.col("of_context")))
    return sized.select("word", "context", "n", value.alias("ppmi")).where(F.col("ppmi") > 0)


def _summed(
    matrix: np.ndarray, place: np.ndarray, weight: np.ndarray | None, row: np.ndarray, rows: int, out: np.ndarray | None = None
) -> np.ndarray:
    """Sums of the matrix' rows at ``place``, weighted, for each of the ascending numbers in ``row``.

    They are added to ``out`` where it is given.
    """
    out = np.zeros((rows, matrix.shape[1])) if out is None else out
    if not len(place):
        return out
    first = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(first, append=len(row))
    most = max(1, GATHERED // max(1, matrix.shape[1]))
    # rows of as many numbers are one small product each, several at once
    order = np.argsort(np.minimum(size, 0xFFFF).astype(np.uint16), kind="stable")
    first, size = first[order], size[order]
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        n = int(size[start])
        if n > LONG_ROW:
            for at in first[start:stop].tolist():
                for k in range(at, at + n, most):
                    part = slice(k, min(k + most, at + n))
                    gathered = matrix[place[part]]
                    out[row[at]] += gathered.sum(axis=0, dtype=float) if weight is None else weight[part] @ gathered
            continue
        step = max(1, most // n)
        for k in range(start, stop, step):
            at = first[k : min(k + step, stop)]
            part = at[:, None] + np.arange(n)
            gathered = matrix[place[part]]
            out[row[at]] += gathered.sum(axis=1, dtype=float) if weight is None else np.matmul(weight[part][:, None, :], gathered)[:, 0]
    return out


def _lists(matrix: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    """Rows of a matrix as lists; those under the mask are null."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()), mask=None if mask is None else pa.array(mask))


def _places(words: pa.ChunkedArray | pa.Array, of: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word stands in ``of``, and whether it does."""
    found = pc.index_in(words, value_set=of.combine_chunks())
    known = pc.is_valid(found).to_numpy(zero_copy_only=False) if isinstance(found, pa.Array) else pc.is_valid(found).to_numpy()
    return pc.fill_null(found, 0).to_numpy(), known


def _multiply(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    """Sums of one block: ``(id, vector)`` of the words of its rows."""
    place, known = _places(pairs["b"], vectors["id"])
    words, row = np.unique(pairs["a"].to_numpy()[known], return_inverse=True)
    sums = np.zeros((0, 0))
    if len(words):
        order = np.argsort(row, kind="stable")
        matrix = flatten_vectors(vectors["vector"].combine_chunks())
        sums = _summed(matrix, place[known][order], pairs["ppmi"].to_numpy()[known][order], row[order], len(words))
    return pa.table({"id": pa.array(words, pa.int64()), "vector": _lists(sums)})


def _product(pairs: DataFrame, vectors: DataFrame, dims: int, grid: int) -> DataFrame:
    """The matrix of pairs, cut into a square ``grid`` of blocks, times the words' vectors.

    Vectors are copied to the blocks of their column, and a word's sums come from the blocks of its
    row: both grow with the root of the number of blocks, whatever the number of tasks.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda row: row * grid + _part("id", grid))
    copies = vectors.select(F.explode(blocks).alias("block"), "id", "vector")
    both = pairs.groupBy("block").cogroup(copies.groupBy("block"))
    parts = both.applyInArrow(_multiply, "id long, vector array<double>")
    if grid == 1:
        return parts
    return parts.groupBy("id").agg(F.array(*[F.sum(F.get("vector", F.lit(j))) for j in range(dims)]).alias("vector"))


def _part(number: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(parts)).cast("int")


def _inner(vectors: DataFrame, dims: int) -> np.ndarray:
    """The sum of ``v vᵀ`` over all words: ``dims ** 2`` numbers, whatever the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                matrix = flatten_vectors(batch.column(0))
                total += matrix.T @ matrix
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["place", "v"])

    rows = vectors.select("vector").mapInArrow(work, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(dims * dims)
    for r in rows:
        out[r["place"]] = r["v"]
    return out.reshape(dims, dims)


def _turned(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every vector times a small matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = flatten_vectors(batch.column(1)) @ matrix
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], names=["id", "vector"])

    return vectors.select("id", "vector").mapInArrow(work, "id long, vector array<double>")


def _axes(inner: np.ndarray, power: float) -> np.ndarray:
    """Directions of the sums' matrix, greatest first, each scaled by its size to ``-power``."""
    size, axes = np.linalg.eigh(inner)
    size, axes = size[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(size))] < 0, -1.0, 1.0)
    kept = size > max(size[0], 0.0) * 1e-10
    return axes * np.where(kept, np.where(kept, size, 1.0) ** -power, 0.0)


def _piece_words(words: int, pieces: int, piece: int) -> int:
    return (words - piece + pieces - 1) // pieces


def _starts(words: int, pieces: int, dims: int, most: int) -> Callable:
    """Arrow function of a piece's words and hashes: the vectors of their signs as blobs."""

    def work(rows: pa.Table) -> pa.Table:
        piece = rows["piece"][0].as_py()
        number = rows["number"].to_numpy()
        bits = np.zeros((_piece_words(words, pieces, piece), dims), np.uint64)
        hashes = flatten_vectors(rows["hashes"].combine_chunks()).view(np.uint64)
        for j in range(dims):
            bits[number, j] = hashes[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)
        return pa.Table.from_batches(_vector_blobs(piece, 1.0 - 2.0 * bits, None, most))

    return work


_VECTORS = "piece int, start int, data binary, met binary"


def _vector_blobs(piece: int, matrix: np.ndarray, met: np.ndarray | None, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a piece's matrix as blobs, one at a time; ``met`` tells which words are in a pair."""
    for start in range(0, len(matrix), most):
        flags = None if met is None else met[start : start + most].tobytes()
        columns = (([piece], pa.int32()), ([start], pa.int32()), ([matrix[start : start + most].tobytes()], pa.binary()), ([flags], pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=["piece", "start", "data", "met"])


def _matrix(blob: pa.BinaryScalar, dims: int) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.float64).reshape(-1, dims)


def _turned_blobs(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every vector of the blobs times a small matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = pa.array([(_matrix(batch["data"][k], len(matrix)) @ matrix).tobytes()], pa.binary())
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one["piece"], one["start"], data, one["met"]], names=["piece", "start", "data", "met"])

    return vectors.mapInArrow(work, _VECTORS)


def _products(pairs: BlockedPairs, dims: int, most: int) -> Callable:
    """Arrow function of a part's rows in order of columns: its words' sums over all pairs.

    The words' sums of counts come first, then each piece's vectors and the pairs with its words.
    After a part's vectors, a row of piece -1 holds the sum of ``v vᵀ`` over them.
    """
    words, pieces, values = pairs.words, pairs.pieces, pairs.values()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, column, sums, met, of, vectors = None, None, {}, {}, {}, np.zeros((0, dims))

        def ended() -> Iterator[pa.RecordBatch]:
            for piece in list(sums):
                matrix = sums.pop(piece)
                yield from _vector_blobs(-1, matrix.T @ matrix, None, dims)
                yield from _vector_blobs(piece, matrix, met[piece], most)

        for batch in batches:
            for r in range(batch.num_rows):
                at = {name: batch[name][r] for name in batch.schema.names}
                if part != at["part"].as_py():
                    yield from ended()
                    part, column, sums, met, of = at["part"].as_py(), None, {}, {}, {}
                piece, col = at["piece"].as_py(), at["col"].as_py()
                if col < 0:
                    of[piece] = _unpacked(at["data"].as_buffer(), "<u8").astype(float)
                    continue
                if column != col:
                    column, vectors = col, np.zeros((_piece_words(words, pieces, col), dims))
                if at["kind"].as_py() == 0:
                    given = _matrix(at["data"], dims)
                    vectors[at["start"].as_py() :][: len(given)] = given
                    continue
                low, flipped = _low(at["data"].as_buffer()), at["flipped"].as_py()
                a, b = (low >> np.uint32(16)).astype(np.uint16), (low & np.uint32(0xFFFF)).astype(np.uint16)
                of_a, of_b = (of[col], of[piece]) if flipped else (of[piece], of[col])
                value = values(_unpacked(at["n"].as_buffer(), "<u8").astype(float), of_a[a], of_b[b])
                good = np.flatnonzero(value > 0)
                row, place = (b, a) if flipped else (a, b)
                if flipped:
                    good = good[np.argsort(row[good], kind="stable")]
                if piece not in sums:
                    size = _piece_words(words, pieces, piece)
                    sums[piece], met[piece] = np.zeros((size, dims)), np.zeros(size, np.uint8)
                row = row[good].astype(np.int64)
                met[piece][row] = 1
                _summed(vectors, place[good], value[good], row, 0, sums[piece])
        yield from ended()

    return work


def _multiplied(pairs: BlockedPairs, vectors: DataFrame, dims: int) -> DataFrame:
    """The matrix of pairs times the words' vectors, both as blobs.

    A part holds the sums of up to ``PART_WORDS`` words and meets the vectors of all words, piece by piece:
    vectors are copied once for each part, and no sum is shuffled.
    """
    parts = max(1, math.ceil(pairs.words / PART_WORDS))
    pieces = pairs.pieces

    def part(piece: str) -> Column:
        return F.floor(F.col(piece) * parts / F.lit(pieces)).cast("int")

    none = F.lit(None).cast("binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    of = pairs.sums.select(every, F.lit(-1).alias("col"), F.lit(0).alias("kind"), "piece", F.lit(0).alias("start"), F.lit(False).alias("flipped"), F.col("of").alias("data"), none.alias("n"))
    sent = vectors.select(every, F.col("piece").alias("col"), F.lit(0).alias("kind"), "piece", "start", F.lit(False).alias("flipped"), "data", none.alias("n"))
    sides = F.array(*[
        F.struct(part(x).alias("part"), F.col(y).alias("col"), F.lit(1).alias("kind"), F.col(x).alias("piece"), F.lit(0).alias("start"), F.lit(flipped).alias("flipped"))
        for x, y, flipped in (("a", "b", False), ("b", "a", True))
    ])
    counted = pairs.blocks.select(F.inline(sides), F.col("low").alias("data"), "n")
    rows = of.unionByName(sent).unionByName(counted).repartition(parts, "part").sortWithinPartitions("part", "col", "kind")
    return rows.mapInArrow(_products(pairs, dims, BLOB_VECTORS), _VECTORS)


def _fit_blocks(pairs: BlockedPairs, dims: int, rounds: int, common: int) -> DataFrame:
    """``fit_words`` of pairs in blocks."""
    pieces = pairs.pieces
    hashes = F.array(*[F.xxhash64(F.lit(k), "word") for k in range(math.ceil(dims / 64))])
    numbered = pairs.names.select(F.pmod("id", F.lit(pieces)).cast("int").alias("piece"), F.expr(f"id div {pieces}").alias("number"), hashes.alias("hashes"))
    vectors = numbered.groupBy("piece").applyInArrow(_starts(pairs.words, pieces, dims, BLOB_VECTORS), _VECTORS)
    last, inner = None, np.zeros((dims, dims))
    for _ in range(rounds + 1):
        before, last = last, stored(_multiplied(pairs, vectors, dims), "word-vectors", compression="uncompressed", batch_rows=BLOB_BATCH)
        if before is not None:
            discarded(before)
        inner = np.zeros((dims, dims))
        for r in last.where("piece < 0").select("data").collect():  # dims ** 2 numbers a piece
            inner = inner + np.frombuffer(r["data"], np.float64).reshape(dims, dims)
        held = last.where("piece >= 0")
        vectors = _turned_blobs(held, _axes(inner, 0.5))
    weights = _axes(inner, 0.25)
    weights[:, :common] = 0.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                met = np.frombuffer(batch["met"][k].as_buffer(), np.uint8) > 0
                number = np.flatnonzero(met) + batch["start"][k].as_py()
                out = _matrix(batch["data"][k], dims)[met] @ weights
                yield pa.RecordBatch.from_arrays([pa.array(number * pieces + batch["piece"][k].as_py()), _lists(out)], names=["id", "vector"])

    fitted = held.mapInArrow(rows, "id long, vector array<double>").join(pairs.names, "id").select("word", "vector")
    fitted = stored(fitted, "word-vectors", compression="uncompressed", batch_rows=BLOB_BATCH)
    discarded(last)
    return fitted


def fit_words(pairs: DataFrame | BlockedPairs, dims: int = 64, rounds: int = 2, common: int = 1) -> DataFrame:
    """``(word, vector)`` from the PPMI of word pairs.

    The start is the signs of hash bits, so the fit is repeatable. The ``common`` greatest
    directions, along which all words lie, are left out.
    """
    if isinstance(pairs, BlockedPairs):
        return _fit_blocks(pairs, dims, rounds, common)
    pairs = stored(pairs.select("word", "context", "ppmi"), "word-pairs")

    def signs(word: Column) -> Column:
        return F.array(*[1.0 - 2.0 * F.getbit(F.xxhash64(F.lit(j // 64), word), F.lit(j % 64)).cast("double") for j in range(dims)])

    names = stored(pairs.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "paired-words")
    grid = max(1, math.ceil(math.sqrt(pairs.count() / BLOCK_PAIRS)), math.ceil(names.count() / BLOCK_WORDS))
    numbered = pairs.join(names.withColumnRenamed("id", "a"), "word").join(names.select(F.col("word").alias("context"), F.col("id").alias("b")), "context")
    coded = stored(numbered.select((_part("a", grid) * grid + _part("b", grid)).alias("block"), "a", "b", "ppmi"), "coded-pairs")
    vectors = names.select("id", signs(F.col("word")).alias("vector"))
    for _ in range(rounds + 1):
        vectors = stored(_product(coded, vectors, dims, grid), "word-vectors")
        inner = _inner(vectors, dims)
        last = vectors
        vectors = _turned(vectors, _axes(inner, 0.5))
    # the last product holds the subspace's directions times their sizes; half of that stays
    weights = _axes(inner, 0.25)
    weights[:, :common] = 0.0
    return stored(_turned(last, weights).join(names, "id").select("word", "vector"), "word-vectors")


def _groups(texts: SplitTexts, most: int) -> DataFrame:
    """``(chunk, group)``: chunks that together hold about ``most`` words share a group."""
    each = texts.chunks.select("chunk", F.lit(0).alias("n")).unionByName(texts.words.select("chunk", "n"))
    sizes = sorted(each.groupBy("chunk").agg(F.sum("n")).collect())  # a row for each chunk, also those without words
    group, held, rows = 0, 0, []
    for chunk, n in sizes:
        if held and held + n > most:
            group, held = group + 1, 0
        held += n
        rows.append((chunk, group))
    return texts.words.sparkSession.createDataFrame(rows, "chunk long, group int")


def _means(schema: pa.Schema, keys: Sequence[str], output: str) -> Callable:
    """Arrow function of groups' rows, vectors before texts: the texts' kept columns and their vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, matrix, found, at = None, None, [], {}
        for batch in batches:
            groups, kinds = batch["group"].to_numpy(), batch["kind"].to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(groups)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if start == stop:
                    continue
                if group != groups[start]:
                    group, matrix, found, at = groups[start], None, [], {}
                part = batch.slice(start, stop - start)
                if not kinds[start]:
                    places, row = part["places"], sum(len(x) for x in found)
                    found.append(flatten_vectors(part["vector"]))
                    each = np.repeat(np.arange(row, row + len(places), dtype=np.int32), pc.list_value_length(places).to_numpy())
                    chunk, local = (x.to_numpy() for x in places.flatten().flatten())
                    for c in np.unique(chunk):
                        at.setdefault(int(c), []).append((local[chunk == c], each[chunk == c]))
                    continue
                if matrix is None:
                    matrix, filled = np.empty((sum(map(len, found)), found[0].shape[1] if found else 0), np.float32), 0
                    found.reverse()
                    while found:
                        some = found.pop()
                        matrix[filled : filled + len(some)] = some
                        filled += len(some)
                for k in range(part.num_rows):
                    kept = pa.ipc.read_record_batch(_expanded(part["rows"][k].as_buffer()), schema)
                    ids, sizes = _unpacked(part["ids"][k].as_buffer(), "<u4"), _unpacked(part["sizes"][k].as_buffer(), "<u4")
                    places = at.get(part["chunk"][k].as_py(), [])
                    if isinstance(places, list):
                        lookup = np.full(max([0, *(int(x.max()) + 1 for x, _ in places)]), -1, np.int32)
                        for local, each in places:
                            lookup[local] = each
                        places = at[part["chunk"][k].as_py()] = lookup
                    place = np.full(len(ids), -1, np.int32)
                    inside = ids < len(places)
                    place[inside] = places[ids[inside]]
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    for key in keys:
                        place[~kept[key].is_valid().to_numpy(zero_copy_only=False)[row]] = -1
                    row, place = row[place >= 0], place[place >= 0]
                    n = np.bincount(row, minlength=len(sizes))
                    sums = _summed(matrix, place, None, row, len(sizes))
                    mean = _lists(sums / np.maximum(n, 1)[:, None], n == 0)
                    yield pa.RecordBatch.from_arrays([*kept.columns, mean], names=[*kept.schema.names, output])

    return work


def _split_vectors(texts: SplitTexts, words: DataFrame, keys: Sequence[str], output: str) -> DataFrame:
    """Kept columns and vectors of split texts: a word's weighed vector ``_v`` travels once a group of chunks.

    It travels in single precision, which is half of what is shuffled here; means are added up in double.
    """
    groups = F.broadcast(_groups(texts, GROUP_WORDS))
    several = max(1, groups.agg(F.max("group")).first()[0] or 0) + 1
    places = texts.words.join(groups, "chunk").groupBy("word").agg(F.collect_list(F.struct("group", "chunk", "local")).alias("all"))
    none = F.lit(None)
    # words are shuffled once, by themselves: to their vectors; then each group they are in gets its places
    met = places.join(words, "word").withColumn("group", F.explode(F.array_distinct(F.col("all.group"))))
    of_group = F.filter("all", lambda x: x["group"] == F.col("group"))
    vectors = met.select(
        "group", F.lit(0).alias("kind"), F.transform(of_group, lambda x: F.struct(x["chunk"].alias("chunk"), x["local"].alias("local"))).alias("places"),
        F.col("_v").cast("array<float>").alias("vector"),
        *[none.cast(kind).alias(name) for name, kind in (("chunk", "long"), ("rows", "binary"), ("sizes", "binary"), ("ids", "binary"))],
    )
    rows = texts.chunks.join(groups, "chunk").select(
        "group", F.lit(1).alias("kind"), none.cast("array<struct<chunk: bigint, local: int>>").alias("places"), none.cast("array<float>").alias("vector"), "chunk", "rows", "sizes", "ids"
    )
    both = vectors.unionByName(rows).repartition(several, "group").sortWithinPartitions("group", "kind")
    schema = StructType([*texts.schema.fields, StructField(output, ArrayType(DoubleType()))])
    return both.mapInArrow(_means(to_arrow_schema(texts.schema), keys, output), schema)


def with_sentence_vectors(
    texts: DataFrame | SplitTexts, words: DataFrame, counts: DataFrame, keys: Sequence[str], text_col: str = "sentence_text",
    output: str = "vector", rarity: float = 1e-3,
) -> DataFrame:
    """Texts with the weighted mean of their known words' vectors; null where none is known.

    A word weighs ``rarity / (rarity + its share of all words)``. ``keys`` tell rows of ``texts``
    apart; rows with a null among them have no vector. Split texts come with the columns they
    keep. Vectors go to the chunks of rows that hold
    their words, and a chunk's means are worked out in its task: no vector of a row is shuffled.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1  # one number
    weight = F.lit(rarity) / (F.lit(rarity) + F.col("n") / F.lit(float(total)))

    def weighed(words: DataFrame, counts: DataFrame) -> DataFrame:
        return words.join(counts, "word").select("word", F.transform("vector", lambda x: x * weight).alias("_v"))

    if isinstance(texts, SplitTexts):
        return _split_vectors(texts, weighed(words, counts), keys, output)
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()
    # neighbouring rows share a chunk; read from files, a row keeps its number
    numbered = stored(
        texts.withColumns({
            "_words": F.when(keyed, words_of(F.col(text_col))),
            "_chunk": F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS),
        }),
        "texts",
    )
    words_held = numbered.select(F.col("_chunk").alias("_of"), F.explode(F.array_distinct("_words")).alias("word")).distinct()
    asked = stored(words_held, "words-held")
    if asked.count() <= FEW_WORDS:
        few = F.broadcast(asked.select("word").distinct())
        words, counts = words.join(few, "word", "left_semi"), counts.join(few, "word", "left_semi")
    needed = asked.join(weighed(words, counts), "word")
    columns = list(texts.columns)

    def means(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        lists = pc.fill_null(rows["_words"].combine_chunks(), []) if rows.num_rows else rows["_words"].combine_chunks()
        place, found = _places(lists.flatten(), vectors["word"])
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[found]
        if len(row):
            sums = _summed(flatten_vectors(vectors["_v"].combine_chunks()), place[found], None, row, len(lists))
        else:
            sums = np.zeros((len(lists), 0))
        n = np.bincount(row, minlength=len(lists))
        mean = _lists(sums / np.maximum(n, 1)[:, None], n == 0)
        return rows.select(columns).append_column(output, mean)

    schema = StructType([*texts.schema.fields, StructField(output, ArrayType(DoubleType()))])
    return numbered.groupBy("_chunk").cogroup(needed.groupBy("_of")).applyInArrow(means, schema)
