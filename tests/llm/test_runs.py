"""Periodic runs against brute force, and the transform behind them."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from innsight.llm import queries, runs


def by_hand(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((u, v - u, q) for (u, v), q in found.items())


def collapsed_by_hand(words):
    gone = {i for start, length, period in by_hand(words) for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_runs_of_short_alphabets(words):
    assert runs.find_runs(np.array(words, np.int64), len(words)) == by_hand(words)


def test_planted_runs():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(20, 300)
        words = [rng.randrange(50) for _ in range(n)]
        for _ in range(3):
            a, p = rng.randrange(n), rng.randint(1, n // 4)
            for i in range(a, rng.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        assert runs.find_runs(np.array(words, np.int64), n) == by_hand(words)


def test_long_uniform_text_stays_linear():
    assert runs.find_runs(np.zeros(300_000, np.int64), 300_000) == [(0, 300_000, 1)]
    assert runs.find_runs(np.arange(300_000) % 5000, 300_000) == [(0, 300_000, 5000)]


@pytest.mark.parametrize("n", [2, 8, 256])
def test_transform_gives_exact_convolutions(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 1000, (2, 3, n))
    got = runs.ntt(runs.ntt(a.astype(np.uint64)) * runs.ntt(b.astype(np.uint64)) % np.uint64(runs.PRIME), inverse=True)
    want = [[sum(int(x[i]) * int(y[(k - i) % n]) for i in range(n)) % runs.PRIME for k in range(n)] for x, y in zip(a, b)]
    assert got.tolist() == want


def test_occurrences_are_zero_mismatch_places():
    words = np.array([1, 2, 3, 4, 9, 1, 2, 3, 4, 7, 7, 7, 7, 0, 0, 0], np.int64)
    values = np.concatenate([words, np.full(8, 99)]).astype(np.uint64)
    at, q = runs.occurrences(values, np.array([0, 4, 8]), 4)
    assert list(zip(at.tolist(), q.tolist())) == [(0, 5)]


def test_edges(spark):
    long = " ".join(["a", "b", "c"] * 20_000) + " end"
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "x x x x x x"), (4, "x x x x x x"), (None, "y y y y y y y"), (5, long),
        (6, "x x x x x"), (7, "a b a b a b a b"), (8, "a b   \x1c x"), (9, "x x x x x x y y y y y y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("runs", "collapsed", "start", "length", "n_runs"):
        docs = docs.withColumn(name, F.lit("z"))
    out = runs.periodic_runs(docs)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    want = sorted(((d, by_hand(runs.WORD.findall(t or "")) if d != 5 else [(0, 60_000, 3)],
                    collapsed_by_hand(runs.WORD.findall(t or "")) if d != 5 else "a b c end") for d, t in rows), key=str)
    assert got == want
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_damage(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate([0, 1, 5, 200] * 30)] + [(None, "a b"), (500, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in queries.damaged_documents(docs).collect()}
    changed = 0
    for r in docs.collect():
        words = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += " ".join(words) != r.text
        assert (got[r.doc_id] or "").split() == words
    assert changed
