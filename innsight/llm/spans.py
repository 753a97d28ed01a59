"""Removing repeated passages: spans of consecutive sentences that occurred before.

Sentences are cut further at words that their content chooses, so that the cuts of a passage
agree wherever it stands. Every run of ``run`` consecutive pieces is hashed; where they hold too
few words, the run goes on by further pieces. Runs meet by hash over the whole corpus. Each but
the first occurrence marks its words; what is marked without a gap is widened word by word as
far as it agrees with the first occurrences of its outer runs, and removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.work import mix, slices, stored, within

#: A sentence ends after . ! ? and the blanks behind, or at line ends, which stay with it.
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s)[^\S\n]*\n*|\n+|\Z)")
#: Scripts without blanks between words (Thai to Khmer, Chinese, Japanese): each character is a word.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_SINGLE}]")
_WORD = re.compile(rf"[{_SINGLE}]|[^\s{_SINGLE}]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def sentences(text: str, longest: int) -> list[str]:
    """Pieces that join to the text; a sentence of over ``longest`` words is cut every so many."""
    out = []
    for piece in _SENTENCE.findall(text):
        if not piece:
            continue
        if len(piece) > 2 * longest and len(piece.split(None, longest)) > longest:
            out.extend(re.findall(r"\s*(?:\S+\s*){1,%d}" % longest, piece))
        else:
            out.append(piece)
    return out


def _words(text: str) -> list[str]:
    text = text.casefold()
    return _WORD.findall(text) if _UNSPACED.search(text) else text.split()


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def _starts(hashed: np.ndarray, lengths: list[int], window: int) -> np.ndarray:
    """Places of the words that start pieces, and the number of words behind them.

    Sentences start pieces, and so does the smallest hash of every ``window`` words of one
    sentence. So no piece is longer than ``window``, and two texts that share a passage agree
    on its pieces from ``window`` words within either end.
    """
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = [np.zeros(1, np.int64), ends]
    if len(hashed) >= window:
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(owner[: len(hashed) - window + 1] == owner[window - 1 :])
        starts.append(at + np.lib.stride_tricks.sliding_window_view(hashed, window)[at].argmin(1))
    return np.unique(np.concatenate(starts))


def _run_hashes(text: str, run: int, least_words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, hash) of the run at each piece.

    A run has ``run`` pieces and goes on until it holds ``least_words`` words; only the last
    pieces, which the end of the text keeps below that, start none, and belong to the runs
    before them. Blank pieces belong to no run; case and blanks between words do not count.
    """
    split = [w for w in map(_words, _SENTENCE.findall(text)) if w]
    hashed = _hashed([w for words in split for w in words])
    starts = _starts(hashed, [len(w) for w in split], window)
    order = np.arange(len(starts) - 1)
    last = np.maximum(order + run, np.searchsorted(starts, starts[:-1] + least_words))
    order = order[last < len(starts)]
    places, ends = starts[order], starts[last[: len(order)]]
    # sums of hash times power: the run's own is a difference, divided by the power it starts at
    powers = np.cumprod(np.r_[_U(1), np.full(len(hashed), _BASE, _U)])
    shares = np.cumprod(np.r_[_U(1), np.full(len(hashed), _INVERSE, _U)])
    sums = np.r_[_U(0), np.cumsum(hashed * powers[:-1], dtype=_U)]
    sizes = ends - places
    out = mix((sums[ends] - sums[places]) * shares[places] + sizes.astype(_U))
    return places.astype(np.int32), sizes.astype(np.int32), out.view(np.int64)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``text_key`` tells the different texts under one id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def span_hashes(docs: DataFrame, run: int, least_words: int, longest: int) -> DataFrame:
    """(hash, doc_id, text_key, place, size) of every span; ``place`` and ``size`` count words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            ids, keys, places, sizes, hashes = [], [], [], [], []
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")), strict=True):
                if doc_id is None or not text:
                    continue
                order, counts, found = _run_hashes(text, run, least_words, max(2, longest // 2))
                ids.append(np.full(len(found), doc_id, np.int64))
                keys.append(np.full(len(found), key, np.int64))
                places.append(order)
                sizes.append(counts)
                hashes.append(found)
            if ids:
                yield pa.record_batch(
                    [pa.array(np.concatenate(x)) for x in (hashes, ids, keys, places, sizes)],
                    names=["hash", "doc_id", "text_key", "place", "size"],
                )

    return docs.mapInArrow(task, "hash long, doc_id long, text_key long, place int, size int")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked words without a gap as one row, with the hashes of the runs at both ends."""
    for batch in batches:
        lists = batch.column("runs")
        place, size, hashes = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        if not len(place):
            continue
        # places of all rows on one line, so that rows never touch
        far = np.int64(place.max()) + size.max() + 2
        end = np.maximum.accumulate(place + size + owner * far)
        first = np.flatnonzero(np.r_[True, place[1:] + owner[1:] * far > end[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        right = np.searchsorted(end, end[last])  # the run that reaches the end
        row = owner[first]
        yield pa.record_batch(
            [
                batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)),
                pa.array(place[first], pa.int32()), pa.array(end[last] - row * far, pa.int32()),
                pa.array(hashes[first], pa.int64()), pa.array(hashes[right], pa.int64()),
            ],
            names=["doc_id", "text_key", "start", "stop", "left", "right"],
        )


def _surroundings(docs: DataFrame, runs: DataFrame, reach: int) -> DataFrame:
    """(hash, before, after): the hashed words on both sides of the runs, the nearest first."""
    wanted = runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("hash", "place", "size")).alias("runs"))
    wanted = stored(wanted, "outer")
    some = within(docs, "text_key", wanted, "text_key").join(wanted, ["doc_id", "text_key"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                hashed = _hashed(_words(text))
                for r in found:
                    at, end = r["place"], r["place"] + r["size"]
                    before, after = hashed[max(0, at - reach) : at][::-1], hashed[end : end + reach]
                    out.append((r["hash"], before.tobytes(), after.tobytes()))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.binary())
                columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch(columns, names=["hash", "before", "after"])

    # rows that repeat an id and the text say the same
    return some.mapInArrow(task, "hash long, before binary, after binary").dropDuplicates(["hash"])


def repeated_spans(docs: DataFrame, spans: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_key, marks): stretches of words that occurred before, and what to widen by.

    Before means in (doc_id, text_key, place) order. The first occurrence comes from a minimum,
    summed up before the shuffle; hashes that occur once leave with it, so only repeated hashes
    are stored and joined back. Both sides of that join are shuffled for it alone, so adaptive
    execution can split a hash that holds a third of all rows. Words around a first occurrence
    are read for the runs at the ends of a stretch only, ``reach`` on each side.
    """
    at = F.struct("doc_id", "text_key", "place", "size")
    first = spans.groupBy("hash").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    again = stored(first.where("n > 1").select("hash", "first"), "repeated")
    some = within(spans, "hash", again, "hash")
    later = some.join(again, "hash").where(at > F.col("first"))
    runs = later.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("place", "size", "hash"))).alias("runs")
    )
    kinds = "doc_id long, text_key long, start int, stop int, `left` long, `right` long"
    stretches = stored(runs.mapInArrow(_stretches, kinds), "stretches")
    ends = stretches.select(F.explode(F.array("left", "right")).alias("hash")).distinct()
    outer = ends.join(again, "hash").select("hash", "first.*")
    around = stored(_surroundings(docs, outer, reach), "around")
    marks = (
        stretches.join(around.select(F.col("hash").alias("left"), "before"), "left", "left")
        .join(around.select(F.col("hash").alias("right"), "after"), "right", "left")
    )
    return marks.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "before", "after"))).alias("marks")
    )


def _agreeing(own: np.ndarray, other: bytes | None) -> int:
    """How many hashed words agree from the first on."""
    there = np.frombuffer(other or b"", _U)
    n = min(len(own), len(there))
    differ = np.flatnonzero(own[:n] != there[:n])
    return int(differ[0]) if len(differ) else n


def _regions(hashed: np.ndarray, marks: list[dict], units: np.ndarray, run: int, most: int) -> list[list[int]]:
    """Widened stretches of words, joined where they meet, that hold ``run`` units or ``most`` words."""
    out: list[list[int]] = []
    for m in marks:
        start = m["start"] - _agreeing(hashed[: m["start"]][::-1], m["before"])
        stop = m["stop"] + _agreeing(hashed[m["stop"] :], m["after"])
        while out and start <= out[-1][1]:
            start, stop = min(start, out[-1][0]), max(stop, out.pop()[1])
        out.append([start, stop])
    whole = [np.searchsorted(units, b, "right") - 1 - np.searchsorted(units, a) for a, b in out]
    return [[a, b] for (a, b), n in zip(out, whole, strict=True) if n >= run or b - a >= most]


def remove_repeated_spans(
    docs: DataFrame, run: int = 3, least_words: int = 12, longest: int = 16,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs``, the text without repeated spans, with ``n_sentences``, ``removed``.

    A repeated stretch of words goes if it holds ``run`` whole sentences and ``least_words``
    words, or ``run * longest`` words (48) wherever it starts and ends; sentences of over
    ``longest`` words count as one for every so many. It is found from 51 words on by the
    pieces' bounds, and below that if it starts and ends with sentences. Stretches are widened
    against the first occurrences of their outer runs, up to ``run * longest / 2`` words on each
    side: where an outer run stood alone still earlier, some words at that end may stay. In
    scripts without blanks each character is a word.

    ``removed`` lists the sentences that are gone wholly (counting those with words, from 0;
    long ones by their parts); what is left keeps its own spelling and blanks. The first
    occurrence in (doc_id, place) order stays, also inside one document. A text that is a full
    copy of an earlier one becomes empty. Null texts stay null and empty ones empty. Rows with a
    null id are left alone. Rows that repeat an id and the text count as one place: the same
    text twice under an id is not a repeat of itself. Different texts under one id are documents
    of their own, each with its own places, in the order of a hash of the text. An empty table
    gives an empty result. Result columns replace columns of the same name. A document's marks
    are held in one row, which is no longer than a few times its text.
    """
    docs = docs.drop(*[c for c in ("n_sentences", "removed") if c in docs.columns and c not in (id_col, text_col)])
    base = _base(docs, id_col, text_col)
    most = run * longest
    spans = stored(span_hashes(base, run, least_words, longest), "spans")
    marks = repeated_spans(base, spans, most // 2).toDF("_id", "_key", "_marks")
    own = (docs[id_col].cast("long") == marks._id) & (F.xxhash64(docs[text_col].cast("string")) == marks._key)
    joined = docs.join(marks, own, "left").drop("_id", "_key")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2_000_000):
            texts, counts, gone = [], [], []
            for text, found in zip(
                batch.column(text_col).to_pylist(), batch.column("_marks").to_pylist(), strict=True
            ):
                worded = [p for p in sentences(text, longest) if p.strip()] if text else []
                counts.append(len(worded))
                marked = []
                if found:
                    units = np.cumsum([0, *(len(_words(p)) for p in worded)])
                    regions = _regions(_hashed(_words(text)), found, units, run, most)
                    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
                    kept, done = [], 0
                    for a, b in regions:
                        kept.append(text[done : at[a]] if a else "")
                        done = at[b]
                        marked.extend(range(np.searchsorted(units, a), np.searchsorted(units, b, "right") - 1))
                    text = "".join(kept) + text[done:]
                texts.append(text)
                gone.append(marked)
            columns = [
                pa.array(texts, pa.string()) if name == text_col else batch.column(name) for name in names
            ]
            yield pa.record_batch(
                [*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int32()))],
                names=[*names, "n_sentences", "removed"],
            )

    return joined.mapInArrow(cut, f"{schema}, n_sentences long, removed array<int>")
