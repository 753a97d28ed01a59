"""The stored index: recall against the exact search, filters, hot buckets, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import retrieval as rt
from innsight.operators import vector_index as vi
from innsight.sources.shared import shared_folder
from suite import listing_queries as lq


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    """At least 0.9 of the ten nearest of every fiftieth vector, against all rows."""
    sf_dir = f"/root/testdata/sf{sf}"
    found = lq.vector_search_indexed(spark, sf_dir)
    corpus = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = corpus.where("cast(doc_id as long) % 50 = 0").withColumnRenamed("doc_id", "query_id")
    exact = rt.search_top_k(queries, corpus, 10)
    share = vi.recall(found, exact).agg(F.avg("recall"), F.min("asked")).first()
    assert share[0] >= 0.9 and share[1] == 10
    scored = found.join(exact.select("query_id", "doc_id", F.round("similarity", 6).alias("s")), ["query_id", "doc_id"])
    assert scored.where("s != similarity").count() == 0


def frames(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 10))
    matrix = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.2, size=(n, 10))
    matrix[: n // 3] = matrix[0]
    rows = [(f"d{i:03d}", "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(matrix)]
    docs = rows + [(None, "a", [1.0] * 10), ("n", "a", None), ("z", "a", [0.0] * 10), ("s", "a", [1.0] * 3), ("k", None, [1.0] * 10)]
    asked = [(f"q{i}", "ab"[i % 2], [float(x) for x in matrix[i]]) for i in range(0, n, 7)] + [("none", "a", None), ("c", "c", [1.0] * 10)]
    return (
        spark.createDataFrame(docs, "doc_id string, kind string, vector array<double>"),
        spark.createDataFrame(asked, "query_id string, kind string, vector array<double>"),
    )


def listed(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["similarity"]) for r in df.collect())


@pytest.mark.parametrize("match_on", [[], ["kind"]])
def test_all_probes_are_exact_with_a_hot_bucket(spark, match_on):
    corpus, asked = frames(spark)
    path = shared_folder(spark, "index")
    vi.write_index(corpus.repartition(5), path, match_on, tables=3, bits=4)
    got = listed(vi.search_index(asked, path, 4, probes=16, block_rows=20))
    usable = corpus.where("doc_id is not null and size(vector) = 10 and kind is not null" if match_on else "doc_id is not null and size(vector) = 10")
    assert got == listed(rt.search_top_k(asked, usable, 4, match_on))


def test_more_probes_find_more(spark):
    corpus, asked = frames(spark)
    path = shared_folder(spark, "index")
    vi.write_index(corpus, path, tables=2, bits=6)
    exact = rt.search_top_k(asked, corpus.where("doc_id is not null and size(vector) = 10"), 10)
    shares = [vi.recall(vi.search_index(asked, path, 10, probes=p), exact).agg(F.avg("recall")).first()[0] for p in (1, 8, 64)]
    assert shares[0] < shares[1] <= shares[2] == 1.0


def test_probes_cross_the_nearest_hyperplanes():
    planes = vi.hyperplanes(5, 2, 3, 7)
    assert (planes == vi.hyperplanes(5, 2, 3, 7)).all()
    matrix = np.random.default_rng(1).normal(size=(20, 5))
    got = vi.probed(matrix, planes, 2, 3, 8)
    for row, v in enumerate(matrix):
        for t in range(2):
            away = planes[3 * t : 3 * t + 3] @ v
            own = sum(1 << i for i in range(3) if away[i] > 0)
            cost = [sum(away[i] ** 2 for i in range(3) if (own ^ b) >> i & 1) for b in got[row, t]]
            assert got[row, t, 0] == own and sorted(got[row, t]) == list(range(8)) and cost == sorted(cost)


def test_empty_index(spark):
    corpus, asked = frames(spark)
    path = shared_folder(spark, "index")
    vi.write_index(corpus.limit(0), path)
    assert vi.search_index(asked, path).count() == 0
