"""Runs that stand or do not, row groups that are skipped, and document folders that are left alone."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from innsight.sources import tables
from innsight.sources.shared import shared_folder

DAY = dt.datetime(2024, 3, 1)


def topics(spark, n=8, gap=0.5):
    return spark.range(n).select(
        F.format_string("p%05d", "id").alias("property_id"), F.lit("weakness").alias("kind"), F.lit("wifi").alias("topic"),
        F.lit(gap).alias("negative_rate_gap"),
    )


def test_a_run_that_fails_midway_is_invisible_and_can_be_repeated(spark):
    base = shared_folder(spark, "runs")
    bad = spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("property_id"))
    with pytest.raises(Exception, match="lost"):
        tables.append_run(base, "r1", {"topics": topics(spark), "neighbors": bad}, DAY)
    assert tables.table_exists(spark, f"{base}/topics")
    assert tables.read_run_table(spark, base, "topics").count() == 0
    near = spark.createDataFrame([("p00001", "p00002", 0.5)], "property_id string, neighbor_property_id string, similarity double")
    tables.append_run(base, "r1", {"topics": topics(spark), "neighbors": near}, DAY)
    assert tables.read_run_table(spark, base, "topics").count() == 8
    assert tables.read_neighbours(spark, base).count() == 1


def test_a_repeated_run_id_adds_nothing(spark):
    base = shared_folder(spark, "runs")
    for gap in (0.5, 0.9):
        tables.append_run(base, "r1", {"topics": topics(spark, gap=gap)}, DAY)
    tables.append_run(base, "r2", {"topics": topics(spark, 3)}, DAY)
    rows = tables.read_run_table(spark, base, "topics").collect()
    assert sorted((r["run_id"], r["negative_rate_gap"]) for r in rows) == [("r1", 0.5)] * 8 + [("r2", 0.5)] * 3
    assert "attempt" not in rows[0].asDict()
    assert tables.complete_runs(spark, base).count() == 2


def test_of_two_attempts_at_once_one_counts(spark):
    """Both writers saw no marker; readers agree on the first that was done."""
    base = shared_folder(spark, "runs")
    tables.append_run(base, "r1", {"topics": topics(spark)}, DAY)
    first = tables.complete_runs(spark, base).first()["attempt"]
    late = spark.range(1).select(F.lit("r1").alias("run_id"), F.lit("other").alias("attempt"), F.current_timestamp().alias("done"))
    late.write.mode("append").parquet(f"{base}/complete")
    shaped = tables._shaped(topics(spark).withColumn("run_id", F.lit("r1")).withColumn("run_utc_ts", F.lit(DAY)), tables.TOPIC_COLUMNS)
    shaped.withColumns({"attempt": F.lit("other"), "run_date": F.to_date("run_utc_ts")}).write.mode("append").partitionBy("run_date").parquet(f"{base}/topics")
    assert [r["attempt"] for r in tables.complete_runs(spark, base).collect()] == [first]
    assert tables.read_run_table(spark, base, "topics").count() == 8


def scanned_rows(df):
    """Rows that leave the scans of a plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.finalPhysicalPlan().collectLeaves() if plan.getClass().getSimpleName().startswith("Adaptive") else plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_row_groups_of_other_properties_are_skipped(spark):
    base = shared_folder(spark, "runs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.append_run(base, "r1", {"topics": topics(spark, 4000)}, DAY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    path = f"{base}/topics"
    whole, one = spark.read.parquet(path), spark.read.parquet(path).where("property_id = 'p01234'")
    assert scanned_rows(whole) == 4000 and 1 <= scanned_rows(one) <= 1000
    # within the range of some row group, but in none: the filter on its values says so
    absent = spark.read.parquet(path).where("property_id = 'p01234x'")
    assert scanned_rows(absent) == 0
    assert scanned_rows(spark.read.parquet(path).where("run_id = 'r0'")) == 0
    assert tables.read_topics(spark, base, property_id="p01234").count() == 1


def docs(spark, first, last, text):
    return spark.range(first, last).select(F.lit("booking_hotels").alias("namespace"), F.concat(F.lit("d"), "id").alias("doc_id"), F.lit(text).alias("text"))


def files(path):
    """Name and time of every data file by folder."""
    out = {}
    for folder, _, names in os.walk(path.removeprefix("file:")):
        for name in names:
            if name.endswith(".parquet"):
                out.setdefault(os.path.basename(folder), set()).add((name, os.stat(os.path.join(folder, name)).st_mtime_ns))
    return out


def test_untouched_folders_keep_their_files(spark):
    path = shared_folder(spark, "corpus")
    assert tables.upsert_documents(spark, path, docs(spark, 0, 400, "old"), 1) == ["booking_hotels"]
    before = files(path)
    tables.upsert_documents(spark, path, docs(spark, 5, 8, "new").unionByName(docs(spark, 900, 901, "new")), 2)
    after = files(path)
    changed = {k for k in after if after[k] != before.get(k)}
    assert 1 <= len(changed) <= 4 and len(before) == tables.BUCKETS
    got = {r["doc_id"]: (r["text"], r["version"]) for r in tables.read_documents(spark, path).collect()}
    assert len(got) == 401 and got["d6"] == ("new", 2) and got["d900"] == ("new", 2) and got["d4"] == ("old", 1)


def test_a_replaced_namespace_keeps_nothing_old(spark):
    path = shared_folder(spark, "corpus")
    other = docs(spark, 0, 50, "kept").withColumn("namespace", F.lit("airbnb_hotels"))
    tables.upsert_documents(spark, path, docs(spark, 0, 400, "old").unionByName(other), 1)
    assert tables.upsert_documents(spark, path, docs(spark, 0, 2, "new"), 2, replace=["booking_hotels"]) == ["booking_hotels"]
    got = sorted((r["namespace"], r["text"]) for r in tables.read_documents(spark, path).collect())
    assert got == [("airbnb_hotels", "kept")] * 50 + [("booking_hotels", "new")] * 2
    assert tables.namespaces(spark, path) == ["airbnb_hotels", "booking_hotels"]
    with pytest.raises(Exception):
        tables.upsert_documents(spark, path, docs(spark, 0, 9, "x"), 3, buckets=7)
