"""Plans have the shape the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from innsight.operators import neighbours as nb
from innsight.operators import retrieval as rt

SF_DIR = "/root/testdata/sf0.001"
TOP_K = ["candidate_sample", "neighbours_topk", "vector_search", "recent_turns", "relevant_reviews", "topic_evidence", "latest_fresh"]
OTHERS = ["topic_gaps", "topic_vector_tag", "amenity_items", "event_listings", "groundedness", "entity_state"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_is_cut_before_the_shuffle(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, SF_DIR))
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", TOP_K + OTHERS)
def test_no_cross_joins(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_row_local_operators_do_not_shuffle(spark):
    payloads = spark.read.parquet(f"{SF_DIR}/events.parquet").select(F.col("event_id").alias("request_id"), F.col("props").alias("payload"))
    from innsight.operators import features as ft
    from innsight.operators import topics as tp
    from innsight.operators import webpayloads as wp

    assert "Exchange" not in plan_of(wp.events(payloads))
    sentences = payloads.select(F.lit("p").alias("property_id"), F.lit("s").alias("sentence_id"), F.col("payload").alias("sentence_text"))
    assert "Exchange" not in plan_of(tp.topics_by_keyword(sentences, {"k": ["k"]}))
    flags, _ = ft.with_amenities(payloads.select(F.lit("p").alias("property_id"), F.col("payload").alias("amenities")), 2)
    assert "Exchange" not in plan_of(flags)


def test_search_reads_only_what_it_needs(spark):
    corpus = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    documents = corpus.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    queries = documents.limit(2).withColumnRenamed("doc_id", "query_id")
    plan = plan_of(rt.search_top_k(queries, documents, 3))
    assert re.search(r"ReadSchema: struct<vec_id:bigint,embedding:array<float>>", plan)
    assert plan.count("Exchange hashpartitioning") == 1


def test_hot_cell_gives_the_same_in_small_blocks(spark):
    n, block = 600, 50
    listings = spark.range(n).select(
        F.col("id").cast("string").alias("property_id"), F.lit("hot").alias("geo_bucket"), F.lit(7).alias("geo_bucket_res"),
        F.lit("hot").alias("h3_7"), F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(0.1)).alias("similarity_vec"),
    )
    columns = ["property_id", "neighbor_property_id", "similarity", "rank"]
    small = nb.top_neighbours(listings, k=3, block_rows=block).select(columns)
    large = nb.top_neighbours(listings, k=3).select(columns)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
