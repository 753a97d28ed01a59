"""Neighbour search against brute force, also with hot cells and tiny blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import neighbours as nb

SCHEMA = (
    "property_id string, geo_bucket string, geo_bucket_res int, h3_5 string, h3_6 string, "
    "similarity_vec array<double>"
)


def listings(spark, n=120, seed=3):
    """A third of all listings in one cell, some equal vectors, two resolutions."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        cell6 = "hot" if i % 3 == 0 else f"c{i % 7}"
        cell5 = f"big{i % 2}"
        res = 6 if i % 4 else 5
        vec = [1.0, 2.0, 3.0] if i % 9 == 0 else [float(x) for x in rng.normal(size=3)]
        rows.append((f"p{i:03d}", cell6 if res == 6 else cell5, res, cell5, cell6, vec))
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute_force(rows, k):
    out = {}
    for pid, bucket, res, _, _, vec in rows:
        scored = []
        for other, _, _, c5, c6, v in rows:
            if other == pid or (c5 if res == 5 else c6) != bucket:
                continue
            cos = np.dot(vec, v) / (np.linalg.norm(vec) * np.linalg.norm(v))
            scored.append((-round(float(cos), 9), other))
        out[pid] = [o for _, o in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("property_id", "rank").collect():
        out.setdefault(r["property_id"], []).append(r["neighbor_property_id"])
    return out


@pytest.mark.parametrize("block_rows", [5, 4096])
def test_all_targets(spark, block_rows):
    rows, df = listings(spark)
    got = found(nb.top_neighbours(df, k=6, block_rows=block_rows))
    assert got == {p: n for p, n in brute_force(rows, 6).items() if n}


def test_some_targets_and_partitions(spark):
    rows, df = listings(spark)
    targets = spark.createDataFrame([("p000",), ("p005",), ("nobody",)], "property_id string")
    expected = {p: n for p, n in brute_force(rows, 6).items() if p in ("p000", "p005")}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert found(nb.top_neighbours(df, targets, k=6, block_rows=7)) == expected
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sampled_search_is_repeatable(spark):
    _, df = listings(spark)
    first = found(nb.top_neighbours(df, k=4, max_candidates=5))
    assert first == found(nb.top_neighbours(df.repartition(3), k=4, max_candidates=5))
    assert all(len(n) == 4 for n in first.values())


def test_unusable_vectors_and_status(spark):
    rows = [
        ("a", "x", 5, "x", "y", [1.0, 0.0]),
        ("b", "x", 5, "x", "y", [0.0, 0.0]),
        ("c", "x", 5, "x", "y", [1.0, float("nan")]),
        ("d", "x", 5, "x", "y", [2.0, 1.0]),
        ("e", "x", 5, "x", "y", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(nb.top_neighbours(df, k=5)) == {"a": ["d"], "d": ["a"]}
    wanted = spark.createDataFrame([("a",), ("b",), ("zz",)], "property_id string")
    status = {r["target_property_id"]: r for r in nb.neighbour_status(df, wanted).collect()}
    assert {p: r["status"] for p, r in status.items()} == {
        "a": "ok", "b": "target_vector_invalid", "zz": "target_not_found"
    }
    assert status["a"]["bucket_candidate_count"] == 1
    assert status["a"]["h3_filter_column"] == "h3_5"


def test_flags_are_respected(spark):
    rows = [("a", [1.0], False, False, 1.0), ("b", [1.0], True, False, 1.0), ("c", [1.0], False, False, 0.0)]
    df = spark.createDataFrame(rows, "property_id string, similarity_vec array<double>, is_bad_vec boolean, has_nan boolean, vec_norm double")
    assert [r[0] for r in nb.usable_vectors(df).collect()] == ["a"]


def test_neighbourhood_keeps_the_target(spark):
    rows, df = listings(spark)
    target = spark.createDataFrame([("p001",)], "property_id string")
    members = {r["property_id"] for r in nb.neighbourhood(df, target).collect()}
    cell = rows[1][1]
    assert members == {r[0] for r in rows if r[4] == cell}
    without = {r["property_id"] for r in nb.neighbourhood(df, target, include_target=False).collect()}
    assert without == members - {"p001"}


def test_missing_targets_raise(spark):
    _, df = listings(spark)
    nb.require_targets(df, ["p001"])
    with pytest.raises(ValueError, match="nobody not found"):
        nb.require_targets(df, ["p001", "nobody"])
    with pytest.raises(ValueError, match="geo_bucket"):
        nb.geo_column(df.drop("geo_bucket"))
    renamed = df.withColumnRenamed("geo_bucket", "_geo_bucket_filled")
    assert nb.geo_column(renamed) == "_geo_bucket_filled"


def test_ml_vectors(spark):
    from pyspark.ml.functions import array_to_vector

    rows, df = listings(spark, 30)
    ml = df.withColumn("similarity_vec", array_to_vector("similarity_vec"))
    assert found(nb.top_neighbours(ml, k=3)) == found(nb.top_neighbours(df, k=3))


def test_sample_takes_exactly_the_cap(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("property_id"), F.lit("hot").alias("cell"))
    sample = nb.sample_candidates(df, 50, ["cell"])
    assert sample.count() == 50
    assert {r[0] for r in sample.collect()} == {r[0] for r in nb.sample_candidates(df.repartition(5), 50, ["cell"]).collect()}
