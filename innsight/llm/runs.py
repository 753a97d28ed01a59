"""Periodic runs of words: stretches that repeat a block at least four times in a row.

Method. A run of period ``q`` is as long as four periods, so for the dyadic scale ``b <= q < 2b``
it holds a whole block of ``b`` words that starts at a multiple of ``b``, and the block occurs
again ``q`` words further on, inside the run. Per scale, the sums of squared differences between
each block and all ``b`` places of the window that follows come from one cyclic convolution, done
as a number-theoretic transform modulo a prime. Integers are exact there: a block that occurs has
the sum zero. (A sum that is a multiple of the prime looks the same; widening compares the words
themselves, so such a place is dropped.) The distance of an occurrence is a candidate period and
is widened to both sides.

Two tests that lose nothing spare most transforms. A block can only occur at a distance below
``2b`` if each of its words does, which next-occurrence distances tell. And a block whose window
lies in a run of a smaller period ``p <= b`` only leads to that run again, since two periods of a
stretch of ``p + q`` words have their greatest common divisor as a period too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.work import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: A prime of the form k * 2^23 + 1 and a generator; products of residues fit 64 bits.
PRIME, GENERATOR = 998_244_353, 3
_CELLS = 1 << 18
_FAR = np.int64(1) << 40

RESULT = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@lru_cache(maxsize=64)
def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first ``n / 2`` powers of an n-th root of unity."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < n // 2:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % np.uint64(PRIME)])
    return out


def ntt(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of every row; row lengths are powers of two."""
    m, n = rows.shape
    prime = np.uint64(PRIME)
    powers, out, size, stride = _powers(n, inverse), rows.reshape(m, n, 1), n, 1
    while size > 1:
        half = size // 2
        low, high = out[:, :half], out[:, half:]
        turned = (low + (prime - high)) * powers[::stride][:half, None] % prime
        out = np.stack([(low + high) % prime, turned], axis=2).reshape(m, half, 2 * stride)
        size, stride = half, 2 * stride
    out = out.reshape(m, n)
    return out * np.uint64(pow(n, PRIME - 2, PRIME)) % prime if inverse else out


def occurrences(values: np.ndarray, starts: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance): where blocks of ``b`` values occur again at distances ``b`` to ``2b - 1``.

    ``values`` are residues; places whose differences' squares sum up to zero modulo the prime.
    """
    prime, n = np.uint64(PRIME), 2 * b
    found = []
    for part in range(0, len(starts), max(1, _CELLS // n)):
        at = starts[part : part + max(1, _CELLS // n)]
        block = values[at[:, None] + np.arange(b)]
        window = values[at[:, None] + np.arange(b, 3 * b)]
        window[:, -1] = 0
        mirrored = np.zeros((len(at), n), np.uint64)
        mirrored[:, -np.arange(b) % n] = block
        product = ntt(ntt(mirrored) * ntt(window) % prime, inverse=True)[:, :b]
        own = (block * block % prime).sum(axis=1) % prime
        sums = np.cumsum(window * window % prime, axis=1)
        sums = np.concatenate([np.zeros((len(at), 1), np.uint64), sums], axis=1)
        there = (sums[:, b:n] - sums[:, :b]) % prime
        rows, q = np.nonzero((own[:, None] + there) % prime == 2 * product % prime)
        found.append((at[rows], q + b))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _agreeing(codes: np.ndarray, at: int, q: int, n: int) -> tuple[int, int]:
    """The widest stretch around ``at`` whose every word equals the one ``q`` further on."""
    end, step = at, 32
    while end + q < n:
        stop = min(end + step, n - q)
        same = codes[end:stop] == codes[end + q : stop + q]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = stop, 2 * step
    start, step = at, 32
    while start > 0:
        stop = max(0, start - step)
        same = (codes[stop:start] == codes[stop + q : start + q])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = stop, 2 * step
    return start, end


def find_runs(codes: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start and then period.

    ``codes`` may be several texts after another when no code is in two of them; ``longest`` is
    the length of the longest. Memory and time grow with the sequence, not with its square.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    follows = codes[order[1:]] == codes[order[:-1]]
    ahead = np.full(1 << max(0, n - 1).bit_length(), _FAR)
    ahead[order[:-1][follows]] = (order[1:] - order[:-1])[follows]
    top = 1 << max(2, longest.bit_length())
    values = np.full(n + 3 * top, 1, np.uint64)
    values[:n] = (codes * 2 + 3) % PRIME
    runs: dict[tuple[int, int], int] = {}
    b, level = 1, ahead
    while 4 * b <= longest and len(level):
        starts = np.flatnonzero(level < 2 * b) * b
        known = sorted(runs)
        lefts = np.array([k[0] for k in known], np.int64)
        reach = np.maximum.accumulate(np.array([k[1] for k in known], np.int64)) if known else lefts

        def apart(s: np.ndarray, e: np.ndarray) -> np.ndarray:
            if not len(lefts):
                return np.ones(len(s), bool)
            place = np.searchsorted(lefts, s, "right") - 1
            return (place < 0) | (reach[place] < e)

        starts = starts[apart(starts, starts + 3 * b - 1)]
        at, q = occurrences(values, starts, b)
        left = apart(at, at + b + q)
        at, q = at[left], q[left]
        after = (at + b + q < n) & (codes[np.minimum(at + b, n - 1)] == codes[np.minimum(at + b + q, n - 1)])
        before = (at > 0) & (codes[at - 1] == codes[at - 1 + q])
        at, q = at[after | before], q[after | before]
        last = (0, 0, 0)
        for i in np.lexsort((at, q)).tolist():
            s, period = int(at[i]), int(q[i])
            if last[2] == period and last[0] <= s < last[1]:
                continue
            u, v = _agreeing(codes, s, period, n)
            last = (u, v, period)
            length = v - u + period
            if length >= max(LEAST_LENGTH, LEAST_EXPONENT * period):
                runs.setdefault((u, v + period), period)
        level = level.reshape(-1, 2).max(axis=1) if len(level) > 1 else level[:0]
        b *= 2
    return sorted((u, v - u, p) for (u, v), p in runs.items())


def _batch(ids: list, texts: list[str]) -> pa.RecordBatch:
    worded = [WORD.findall(t) for t in texts]
    sizes = np.array([len(w) for w in worded], np.int64)
    ends = np.cumsum(sizes)
    flat = pa.array([w for words in worded for w in words], pa.string()).dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    codes += np.repeat(np.arange(len(texts)), sizes) * max(1, len(flat.dictionary))
    found: list[list] = [[] for _ in texts]
    dropped: dict[int, np.ndarray] = {}
    for start, length, period in find_runs(codes, int(sizes.max(initial=0))):
        d = int(np.searchsorted(ends, start, "right"))
        own = int(start - (ends[d] - sizes[d]))
        found[d].append({"start": own, "length": int(length), "period": int(period)})
        gone = dropped.setdefault(d, np.zeros(int(sizes[d]), bool))
        gone[own + period : own + length] = True
    collapsed = [
        " ".join(words) if d not in dropped else " ".join([w for w, x in zip(words, dropped[d].tolist(), strict=True) if not x])
        for d, words in enumerate(worded)
    ]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(found, pa.list_(run)), pa.array(collapsed, pa.string())],
        names=["doc_id", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): every run of a text's words, and the text with runs cut short.

    Words are stretches without ASCII blanks, numbered from 0. A run is a stretch with smallest
    period ``q`` of at least ``max(6, 4 q)`` words that no neighbouring word lengthens. ``runs``
    is sorted by start, then period. ``collapsed`` holds the words that no run contains after
    its first ``q`` words, joined by one blank.

    A null, empty or blank text has no runs and collapses to the empty text. Texts of any
    length are read whole; a task holds the words of about 1 MB of texts at once, or of one
    longer text. Each row stands for itself: repeated rows, equal ids and null ids each give
    their own row. An empty table gives an empty result. Only the two named columns are read,
    so others cannot clash. Nothing is shuffled, so a lost executor repeats its own texts only.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            yield _batch(part.column("doc_id").to_pylist(), part.column("text").to_pylist())

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(work, RESULT)
