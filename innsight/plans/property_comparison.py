"""The review comparison: properties against their neighbours, from listings to run tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import COMPARISON_DEFAULTS
from innsight.functions import text as tx
from innsight.operators import neighbours as nb
from innsight.operators import report as rp
from innsight.operators import sentences as st
from innsight.operators import topics as tp
from innsight.sources import tables

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Comparison:
    """Frames of one comparison; ``close`` frees the sentences kept between them."""

    status: DataFrame
    neighbours: DataFrame
    similarity: DataFrame
    volume: DataFrame
    topics: DataFrame
    evidence: DataFrame
    kept: list[DataFrame]

    def close(self) -> None:
        for frame in self.kept:
            frame.unpersist()


def involved_properties(neighbours: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Targets and their neighbours, each once."""
    return nb.members(neighbours, targets).select(F.col("member_id").alias("property_id")).distinct()


def embedding_tagger(
    topics: DataFrame, model, *, threshold: float, top_n: int, max_non_ascii: float
) -> Step:
    """Tagging by a fitted embedding: topics and sentences go through the same model."""
    vectors = st.embed(topics.withColumn("sentence_text", F.col("topic")), model).select("topic", "vector")
    return lambda sentences: tp.topics_by_vector(
        st.embed(sentences, model), vectors, threshold=threshold, top_n=top_n, max_non_ascii=max_non_ascii,
        keep=tp.SENTENCE_COLUMNS,
    )


def keyword_tagger(keywords: dict, top_n: int = 2, max_non_ascii: float = 0.20) -> Step:
    """Tagging by the share of a topic's keywords found in a sentence."""
    return lambda sentences: tp.topics_by_keyword(
        sentences, keywords, top_n=top_n, max_non_ascii=max_non_ascii, keep=tp.SENTENCE_COLUMNS
    )


def compare_properties(
    listings: DataFrame,
    tag_topics: Step,
    label_sentiment: Step = st.lexicon_sentiment,
    targets: DataFrame | None = None,
    *,
    max_reviews: int | None = None,
    max_candidates: int | None = None,
    seed: int = 42,
    params: dict | None = None,
    keep_sentences: bool = True,
) -> Comparison:
    """Compare all listings, or those in ``targets``, with their neighbours.

    ``tag_topics`` turns sentences into one row per sentence and topic, with all sentence
    columns (see :func:`embedding_tagger` and :func:`keyword_tagger`).

    Only listings that are a target or a neighbour have their reviews split. The tagged
    sentences are kept for the aggregates that share them; they are recomputed where an
    executor is lost.
    """
    p = {**COMPARISON_DEFAULTS, **(params or {})}
    requested = listings.select("property_id") if targets is None else targets
    near = nb.top_neighbours(listings, targets, k=p["top_k_neighbors"], max_candidates=max_candidates, seed=seed)
    status = nb.neighbour_status(listings, requested, k=p["top_k_neighbors"], max_candidates=max_candidates, seed=seed)
    kept = []
    if keep_sentences:
        near = near.persist(StorageLevel.MEMORY_AND_DISK)
        status = status.persist(StorageLevel.MEMORY_AND_DISK)
        kept += [near, status]
    # a property that is alone in its cell is reported on as well
    compared = status.filter("status = 'ok'").select(F.col("target_property_id").alias("property_id"))
    subset = listings.select(F.col("property_id").cast("string").alias("property_id"), "reviews").join(
        involved_properties(near, compared), "property_id", "left_semi"
    )
    sentences = label_sentiment(st.split_sentences(st.explode_reviews(subset, max_reviews=max_reviews)))
    if keep_sentences:
        sentences = sentences.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(sentences)
    enriched = tag_topics(sentences)
    if keep_sentences:
        enriched = enriched.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(enriched)
    gaps = rp.topic_gaps(enriched, near, targets=compared)
    topics = rp.rank_topics(gaps, p["top_k_weakness_topics"], p["top_k_strength_topics"])
    return Comparison(
        status=status,
        neighbours=near,
        similarity=nb.similarity_stats(near),
        volume=st.sentence_volume(sentences, near, compared),
        topics=topics,
        evidence=rp.evidence_of_topics(topics, rp.topic_evidence(enriched, near, p["top_k_examples"], targets=compared)),
        kept=kept,
    )


def payloads(comparison: Comparison) -> DataFrame:
    """One JSON report per requested property: ``(property_id, payload_json)``.

    The lists inside are short by construction: k neighbours, eight topics per kind, k
    sentences per role.
    """
    c = comparison
    near = c.neighbours.groupBy("property_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "neighbor_property_id", "similarity"))),
            lambda n: F.struct(n["neighbor_property_id"].alias("neighbor_property_id"), n["similarity"].alias("similarity")),
        ).alias("neighbor_list")
    )
    topics = rp.with_examples(c.topics, c.evidence.drop("kind").dropDuplicates(
        ["property_id", "topic", "evidence_role", "evidence_rank"]
    ))
    body = F.struct(
        "rank", "topic", "target_sentence_topic_assignments", "target_negative_assignments",
        "target_negative_rate", "neighbors_sentence_topic_assignments", "neighbors_negative_assignments",
        "neighbors_negative_rate", "negative_rate_gap", *[f"{role}_examples" for role in rp.ROLES],
    )
    lists = topics.groupBy("property_id").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, body))).alias(name)
            for kind, name in (("weakness", "weaknesses"), ("strength", "strengths"))
        ]
    )
    joined = (
        c.status.withColumnRenamed("target_property_id", "property_id")
        .join(near, "property_id", "left")
        .join(c.similarity, "property_id", "left")
        .join(c.volume, "property_id", "left")
        .join(lists, "property_id", "left")
    )
    payload = F.struct(
        F.col("property_id").alias("target_property_id"),
        F.struct(
            "neighbor_list",
            F.struct("neighbors_selected_count", "similarity_avg", "similarity_min", "similarity_max").alias("similarity_stats"),
            F.struct(*[x for x in c.status.columns if x != "target_property_id"]).alias("selection_metadata"),
        ).alias("neighbors"),
        F.struct("target_distinct_sentences_used", "neighbors_distinct_sentences_used").alias("text_volume"),
        F.struct(
            F.col("weaknesses").alias("weaknesses_vs_neighbors"), F.col("strengths").alias("strengths_vs_neighbors")
        ).alias("results"),
    )
    return joined.select("property_id", F.to_json(payload).alias("payload_json"))


def write_comparison(comparison: Comparison, base: str, run_id: str | None = None, run_ts=None) -> dict:
    """Append a comparison to the run tables."""
    run_id = run_id or tables.new_run_id()
    c = comparison
    runs = (
        payloads(c)
        .join(c.status.select(F.col("target_property_id").alias("property_id"), "status"), "property_id")
        .join(c.similarity, "property_id", "left")
        .join(c.volume, "property_id", "left")
    )
    frames = {"runs": runs, "neighbors": c.neighbours, "topics": c.topics, "evidence": c.evidence}
    return {"run_id": run_id, **tables.append_run(base, run_id, frames, run_ts)}


def run_comparison(
    listings: DataFrame, property_ids: list[str], base: str, tag_topics: Step, **options
) -> dict:
    """The job for some properties: compare, write, and leave an error row when it fails."""
    spark = listings.sparkSession
    run_id = tables.new_run_id()
    targets = spark.createDataFrame([(str(p),) for p in property_ids], "property_id string")
    comparison = None
    try:
        nb.require_targets(listings, property_ids)
        comparison = compare_properties(listings, tag_topics, targets=targets, **options)
        return {"status": "ok", "run_id": run_id, "written": write_comparison(comparison, base, run_id)}
    except Exception as error:  # a failed run must be visible to the readers of the tables
        failed = tables.error_run(spark, [str(p) for p in property_ids], str(error))
        tables.append_run(base, run_id, {"runs": failed})
        return {"status": "error", "run_id": run_id, "error_message": str(error)}
    finally:
        if comparison is not None:
            comparison.close()


def report_lines(topics: DataFrame, neighbours: DataFrame, max_neighbours: int = 10, max_topics: int = 5) -> DataFrame:
    """The readable report as numbered lines per property and section."""
    near = neighbours.filter(F.col("rank") <= max_neighbours).select(
        "property_id", F.lit("neighbors").alias("section"), F.col("rank").alias("position"),
        F.concat(
            F.lit("- Property "), "neighbor_property_id", F.format_string(": %.2f%% similarity", F.col("similarity") * 100)
        ).alias("line"),
    )
    window = Window.partitionBy("property_id", "kind").orderBy(F.desc(F.abs("negative_rate_gap")), "rank", "topic")
    verdict = F.when(F.col("kind") == "weakness", "worse").otherwise("better")
    line = F.concat(
        F.lit("**"), tx.title_case(F.col("topic")), F.lit("**"),
        F.format_string(
            " Your negative rate: %.1f%% | Neighbors: %.1f%% Gap: %+.1f%% (you're ",
            F.col("target_negative_rate") * 100, F.col("neighbors_negative_rate") * 100,
            F.col("negative_rate_gap") * 100,
        ),
        verdict, F.lit(")"),
    )
    ranked = topics.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= max_topics)
    return near.unionByName(
        ranked.select("property_id", F.col("kind").alias("section"), "position", line.alias("line"))
    )


def evidence_lines(evidence: DataFrame, limit: int = 5) -> DataFrame:
    """The leading evidence per property as lines, each text cut to 200 characters."""
    window = Window.partitionBy("property_id").orderBy(
        F.desc("topic_similarity"), "topic", "sentence_id", "kind", "evidence_role"
    )
    line = F.concat(
        F.lit("["), "topic", F.lit("] ("), "sentiment_label", F.lit('): "'),
        F.substring("sentence_text", 1, 200), F.lit('..."'),
    )
    return (
        evidence.withColumn("position", F.row_number().over(window))
        .filter(F.col("position") <= limit)
        .select("property_id", "position", line.alias("line"))
    )
