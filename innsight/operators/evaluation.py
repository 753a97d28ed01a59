"""Scores of test scenarios and feedback of test sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import FAILURE_MARKERS, RATING_DIMENSIONS
from innsight.functions import text as tx

MIN_RESPONSE_CHARS = 50


def _names(text: Column) -> Column:
    return F.transform(F.split(text, ","), tx.strip)


def score_scenarios(runs: DataFrame) -> DataFrame:
    """Add ``routing_correct`` and ``success`` to scenario runs.

    Needs ``expected_agent``, ``agent_used`` (comma lists) and ``response``. A run without
    a response failed.
    """
    failed = tx.contains_any(F.lower("response"), FAILURE_MARKERS)
    return (
        runs.withColumn(
            "routing_correct",
            F.coalesce(F.arrays_overlap(_names(F.col("expected_agent")), _names(F.col("agent_used"))), F.lit(False)),
        )
        .withColumn("response_length", F.length("response"))
        .withColumn(
            "success", F.coalesce((F.col("response_length") > MIN_RESPONSE_CHARS) & ~failed, F.lit(False))
        )
    )


def scenario_summary(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Success rate, routing accuracy and mean time; a missing time counts as zero."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("total_tests"),
        F.count_if("success").alias("successful"),
        F.count_if("routing_correct").alias("routing_correct"),
        (F.count_if("success") / F.count("*")).alias("success_rate"),
        (F.count_if("routing_correct") / F.count("*")).alias("routing_accuracy"),
        F.avg(F.coalesce("elapsed_seconds", F.lit(0.0))).alias("avg_response_time"),
    )


def rating_means(feedback: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Mean rating per dimension with the number of ratings; null and 0 are no rating."""
    columns = [f"{d}_rating" for d in RATING_DIMENSIONS]
    long = feedback.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), columns, "dimension", "rating"
    )
    given = F.when(F.col("rating") != 0, F.col("rating"))
    return (
        long.withColumn("dimension", F.regexp_replace("dimension", "_rating$", ""))
        .groupBy(*keys, "dimension")
        .agg(F.avg(given).alias("mean_rating"), F.count(given).alias("n"))
    )


def session_metrics(feedback: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Interactions, share that would come back, and response times per session."""
    time = F.when(F.col("elapsed_seconds") != 0, F.col("elapsed_seconds"))
    return feedback.groupBy(*keys).agg(
        F.count("*").alias("interactions"),
        F.count_if("would_use_again").alias("would_use_again"),
        F.count("would_use_again").alias("would_use_again_n"),
        F.try_divide(F.count_if("would_use_again"), F.count("would_use_again")).alias("would_use_again_share"),
        F.avg(time).alias("avg_time"),
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
    )


def session_report(feedback: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The whole report as rows: ``(session_id, section, metric, value, n)``."""
    ratings = rating_means(feedback, keys).select(
        *keys, F.lit("ratings").alias("section"), F.col("dimension").alias("metric"),
        F.col("mean_rating").alias("value"), "n",
    )
    metrics = session_metrics(feedback, keys)
    names = ["would_use_again_share", "avg_time", "min_time", "max_time"]
    other = (
        metrics.select(*keys, F.col("interactions").alias("n"), *[F.col(c).cast("double").alias(c) for c in names])
        .unpivot([*keys, "n"], names, "metric", "value")
        .select(*keys, F.lit("other").alias("section"), "metric", "value", "n")
    )
    return ratings.unionByName(other)


def comments(feedback: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "timestamp") -> DataFrame:
    """Non-empty comments with the time they were given."""
    return feedback.filter(F.coalesce("comments", F.lit("")) != "").select(*keys, order, "comments")
