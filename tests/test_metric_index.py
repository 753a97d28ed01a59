"""Nearest vectors by pivots: all pairs' results, fewer pairs on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import metric_index as mi

SCHEMA = "key string, id string, vec array<double>, is_target boolean"


def clustered(n, clusters, dims, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return centres[rng.integers(0, clusters, n)] + rng.normal(scale=spread, size=(n, dims))


def entries(spark, matrix, keys, targets=lambda i: True):
    rows = [(keys(i), f"p{i:04d}", [float(x) for x in v], t) for i, v in enumerate(matrix) for t in ((False, True) if targets(i) else (False,))]
    return spark.createDataFrame(rows, SCHEMA)


def brute(matrix, keys, k, targets=lambda i: True):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, mi.TIE_DIGITS)
    out = {}
    for i in range(len(matrix)):
        if targets(i):
            others = [j for j in range(len(matrix)) if j != i and keys(j) == keys(i)]
            best = sorted((-scores[i, j], f"p{j:04d}") for j in others)[:k]
            if best:
                out[f"p{i:04d}"] = best
    return out


def found(df, k):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((-r["similarity"], r["near_id"]))
    assert all(len({n for _, n in v}) == len(v) for v in out.values())
    return {i: sorted(v)[:k] for i, v in out.items()}


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_equals_all_pairs(spark, spread):
    """A group with most rows, small ones, equal vectors and a group without targets."""
    matrix = clustered(700, 9, 6, spread, 4)
    matrix[:90] = matrix[0]
    keys = lambda i: "hot" if i % 4 else f"k{i % 24}"
    targets = lambda i: keys(i) != "k0" and i % 3 != 1
    got = found(mi.nearest(entries(spark, matrix, keys, targets), 5, block_rows=16), 5)
    assert got == brute(matrix, keys, 5, targets)


def test_share_of_pairs_falls_on_clusters(spark):
    keys = lambda i: "one"
    shares = {}
    for name, spread in (("tight", 0.01), ("loose", 5.0)):
        rows = entries(spark, clustered(2000, 25, 16, spread, 5), keys)
        scored, pairs = mi.scored_share(rows, 5, block_rows=50)
        shares[name] = scored / pairs
    assert shares["tight"] < 0.15 < shares["loose"] <= 1.0


def test_skipped_blocks_get_no_copies(spark):
    """Two far groups of directions: no target is sent to a pivot of the other group."""
    rng = np.random.default_rng(6)
    matrix = np.vstack([rng.normal([9, 0, 0], 0.1, (200, 3)), rng.normal([0, 9, 0], 0.1, (200, 3))])
    rows = entries(spark, matrix, lambda i: "one")
    placed, pivots = mi.placed_entries(rows, 20)
    first = mi._own_block(placed, pivots, 3, 20, True)
    left = mi.reachable(placed, pivots, first, 3, 20).select("id", "pivot").distinct()
    side = {r["pivot"]: r["vec"][0] > r["vec"][1] for r in pivots.where("vec is not null").collect()}
    assert len(set(side.values())) == 2
    for r in left.collect():
        assert side[r["pivot"]] == (r["id"] < "p0200")


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mi.nearest(none, 3).count() == 0
    only = spark.createDataFrame([("a", "x", [1.0, 0.0], True), ("b", "y", [1.0, 0.0], False)], SCHEMA)
    assert mi.nearest(only, 3).count() == 0
    same = entries(spark, np.ones((60, 4)), lambda i: "one")
    got = found(mi.nearest(same, 4, block_rows=7), 4)
    assert got["p0000"] == [(-1.0, f"p{j:04d}") for j in (1, 2, 3, 4)] and len(got) == 60
    itself = found(mi.nearest(same, 2, block_rows=7, not_itself=False), 2)
    assert itself["p0005"] == [(-1.0, "p0000"), (-1.0, "p0001")]


def test_queries_against_a_corpus(spark):
    """Targets that are no candidates, and more of them than candidates."""
    corpus, asked = clustered(90, 5, 4, 0.2, 7), clustered(400, 5, 4, 0.2, 8)
    rows = spark.createDataFrame(
        [("k", f"d{i:03d}", [float(x) for x in v], False) for i, v in enumerate(corpus)]
        + [("k", f"q{i:03d}", [float(x) for x in v], True) for i, v in enumerate(asked)], SCHEMA
    ).withColumn("vec", F.col("vec"))
    got = found(mi.nearest(rows, 3, block_rows=20, not_itself=False), 3)
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (asked, corpus)]
    scores = np.round(unit[0] @ unit[1].T, mi.TIE_DIGITS)
    for i in range(len(asked)):
        assert got[f"q{i:03d}"] == sorted((-scores[i, j], f"d{j:03d}") for j in range(len(corpus)))[:3]
