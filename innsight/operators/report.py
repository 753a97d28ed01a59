"""Weaknesses and strengths of each property against its neighbours, with evidence.

All properties are compared in one job. Sentences are reduced to one row per property,
topic and label, and to the best few sentences of each, before neighbours are joined:
the join works on summaries, never on sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import EVIDENCE_CHARS
from innsight.functions import text as tx
from innsight.operators.neighbours import members
from innsight.operators.topics import resolve_topic

EVIDENCE_FIELDS = [
    "property_id", "review_idx", "sent_idx", "sentence_id", "topic_similarity", "sentiment_label",
    "sentence_text",
]
ROLES = ["target_negative", "target_positive", "neighbors_positive", "neighbors_negative"]
_COUNTS = ["sentence_topic_assignments", "negative_assignments"]


def enrich(sentences: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sentences joined with their topic assignments."""
    return sentences.join(assignments, ["property_id", "sentence_id"]).select(
        "property_id", "review_idx", "sent_idx", "sentence_id", "topic", "topic_similarity",
        "sentiment_label", "sentence_text",
    )


def topic_counts(enriched: DataFrame, keys: tuple[str, ...] = ("property_id", "topic")) -> DataFrame:
    """Assignments and negative assignments per property and topic."""
    negative = F.when(F.col("sentiment_label") == "negative", 1).otherwise(0)
    return enriched.groupBy(*keys).agg(
        F.count("*").alias("sentence_topic_assignments"),
        F.sum(negative).alias("negative_assignments"),
    )


def negative_rate(negative: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(negative, total), F.lit(0.0))


def topic_stats(enriched: DataFrame) -> DataFrame:
    counts = topic_counts(enriched)
    return counts.withColumn(
        "negative_rate",
        negative_rate(F.col("negative_assignments"), F.col("sentence_topic_assignments")),
    )


def topic_gaps(
    enriched: DataFrame, neighbours: DataFrame, min_assignments: int = 0, targets: DataFrame | None = None
) -> DataFrame:
    """Negative rates of each property and of its neighbours, and their difference, per topic.

    A topic seen on one side only counts as rate zero on the other. ``min_assignments``
    leaves out topics with fewer assignments on both sides together. ``targets`` are compared
    even without neighbours.
    """
    counts = topic_counts(enriched).withColumnRenamed("property_id", "member_id")
    both = (
        members(neighbours, targets)
        .join(counts, "member_id")
        .groupBy("property_id", "topic")
        .agg(
            *[
                F.sum(F.when(F.col("side") == side, F.col(c)).otherwise(0)).alias(f"{side}_{c}")
                for side in ("target", "neighbors")
                for c in _COUNTS
            ]
        )
    )
    for side in ("target", "neighbors"):
        both = both.withColumn(
            f"{side}_negative_rate",
            negative_rate(
                F.col(f"{side}_negative_assignments"), F.col(f"{side}_sentence_topic_assignments")
            ),
        )
    seen = F.col("target_sentence_topic_assignments") + F.col("neighbors_sentence_topic_assignments")
    return both.withColumn(
        "negative_rate_gap", F.col("target_negative_rate") - F.col("neighbors_negative_rate")
    ).filter(seen >= min_assignments)


def rank_topics(gaps: DataFrame, top_weaknesses: int = 8, top_strengths: int | None = None) -> DataFrame:
    """The widest and the narrowest gaps per property as ``kind`` weakness and strength."""
    top_strengths = top_weaknesses if top_strengths is None else top_strengths

    def place(kind: str, order: Column, limit: int) -> Column:
        rank = F.row_number().over(Window.partitionBy("property_id").orderBy(order, "topic"))
        return F.when(rank <= limit, F.struct(F.lit(kind).alias("kind"), rank.alias("rank")))

    # bounded: a property has one row per topic, so both orders share one small partition
    placed = gaps.withColumns(
        {
            "_weak": place("weakness", F.desc("negative_rate_gap"), top_weaknesses),
            "_strong": place("strength", F.asc("negative_rate_gap"), top_strengths),
        }
    )
    kinds = F.filter(F.array("_weak", "_strong"), lambda k: k.isNotNull())
    return placed.select(*gaps.columns, F.inline(kinds))


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(
        F.desc("topic_similarity"), "evidence_property_id", "review_idx", "sent_idx", "sentence_id"
    )
    return rows.withColumn("evidence_rank", F.row_number().over(window)).filter(F.col("evidence_rank") <= k)


def topic_evidence(enriched: DataFrame, neighbours: DataFrame, k: int = 3, targets: DataFrame | None = None
) -> DataFrame:
    """The best ``k`` sentences per property, topic and role, one row each.

    The best of a property's neighbours are among the best of each neighbour, so sentences
    are cut to k per property, topic and label before the neighbours are joined.
    """
    labelled = enriched.filter(F.col("sentiment_label").isin("positive", "negative"))
    sentences = labelled.withColumnRenamed("property_id", "evidence_property_id")
    best = _best(sentences, ["evidence_property_id", "topic", "sentiment_label"], k).drop("evidence_rank")
    shown = members(neighbours, targets).withColumnRenamed("member_id", "evidence_property_id").join(
        best, "evidence_property_id"
    )
    roles = shown.withColumn("role", F.concat_ws("_", "side", "sentiment_label"))
    return _best(roles, ["property_id", "topic", "role"], k).select(
        "property_id", "topic", F.col("role").alias("evidence_role"), "evidence_rank",
        "evidence_property_id", "review_idx", "sent_idx", "sentence_id", "topic_similarity",
        "sentiment_label", "sentence_text",
    )


def evidence_of_topics(topics: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows of the chosen topics, once per kind."""
    return topics.select("property_id", "kind", "topic").join(evidence, ["property_id", "topic"])


def with_examples(topics: DataFrame, evidence: DataFrame) -> DataFrame:
    """Attach one array of evidence structs per role; an empty one where there is none."""
    fields = [F.col("evidence_property_id").alias("property_id")] + [F.col(c) for c in EVIDENCE_FIELDS[1:]]
    ordered = F.array_sort(
        F.collect_list(F.struct("evidence_role", "evidence_rank", F.struct(*fields).alias("item")))
    )
    # bounded: at most four roles of k sentences per property and topic
    grouped = evidence.groupBy("property_id", "topic").agg(ordered.alias("items"))
    joined = topics.join(grouped, ["property_id", "topic"], "left")
    for role in ROLES:
        joined = joined.withColumn(f"{role}_examples", F.coalesce(_of_role(role), _no_items(evidence)))
    return joined.drop("items")


def _of_role(role: str) -> Column:
    return F.transform(F.filter("items", lambda x: x["evidence_role"] == role), lambda x: x["item"])


def _no_items(evidence: DataFrame) -> Column:
    kinds = ",".join(
        f"{c}:{evidence.schema['evidence_property_id' if c == 'property_id' else c].dataType.simpleString()}"
        for c in EVIDENCE_FIELDS
    )
    return F.array().cast(f"array<struct<{kinds}>>")


def lean_examples(report: DataFrame) -> DataFrame:
    """Replace the evidence structs by their sentence texts."""
    for role in ROLES:
        name = f"{role}_examples"
        report = report.withColumn(name, F.transform(name, lambda x: x["sentence_text"]))
    return report


def capped_evidence(evidence: DataFrame, limit: int = EVIDENCE_CHARS) -> DataFrame:
    return evidence.withColumn("sentence_text", tx.cap(F.col("sentence_text"), limit, "…"))


def unique_topics(topics: DataFrame) -> DataFrame:
    """Weaknesses, then strengths, each topic once per property."""
    first = F.when(F.col("kind") == "weakness", 0).otherwise(1)
    window = Window.partitionBy("property_id", "topic").orderBy(first, "rank")
    return topics.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")


def bubble_feed(topics: DataFrame) -> DataFrame:
    """Chart feed per property and topic: impact, confidence, bubble size and colour.

    Sizes map the 10 % to 90 % quantile range of the neighbour assignments to 30..1200,
    falling back to the full range, then to 0..1.
    """
    unique = unique_topics(topics)
    raw = F.col("neighbors_sentence_topic_assignments").cast("double")
    # bounded: one row per topic of a property
    spans = unique.groupBy("property_id").agg(
        F.percentile(raw, 0.10).alias("q1"), F.percentile(raw, 0.90).alias("q2"),
        F.min(raw).alias("low"), F.max(raw).alias("high"),
    )
    by_quantile = F.col("q2") > F.col("q1")
    by_range = F.col("high") > F.col("low")
    low = F.when(by_quantile, F.col("q1")).when(by_range, F.col("low")).otherwise(0.0)
    high = F.when(by_quantile, F.col("q2")).when(by_range, F.col("high")).otherwise(1.0)
    position = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - low) / (high - low)))
    total = F.col("target_sentence_topic_assignments") + F.col("neighbors_sentence_topic_assignments")
    impact = F.lit(0.0) - F.col("negative_rate_gap")
    return unique.join(spans, "property_id").select(
        "property_id",
        "topic",
        impact.alias("impact_x"),
        F.log1p(total.cast("double")).alias("confidence_y"),
        (F.lit(30.0) + position * F.lit(1170.0)).alias("bubble_s"),
        F.when(impact >= 0, "green").otherwise("red").alias("color"),
    )


def focus_topic(topics: DataFrame, questions: DataFrame, term_col: str = "term") -> DataFrame:
    """The first reported topic that contains what a question is about, per property.

    ``questions`` holds ``property_id`` and the user's term. Questions without a matching
    topic keep nulls.
    """
    resolved = _resolved_focus(questions, term_col)
    hit = F.contains(F.lower(F.col("topic")), F.lower(F.col("matched_topic")))
    first = F.when(F.col("kind") == "weakness", 0).otherwise(1)
    window = Window.partitionBy("property_id", term_col).orderBy(
        F.when(F.col("topic").isNull(), 1).otherwise(0), first, "rank"
    )
    reported = topics.select(
        "property_id", "kind", "topic", "rank", "target_negative_rate", "neighbors_negative_rate",
        "negative_rate_gap",
    )
    q = resolved.alias("q")
    t = reported.alias("t")
    joined = q.join(t, (F.col("q.property_id") == F.col("t.property_id")) & hit, "left").select(
        F.col("q.property_id").alias("property_id"), term_col, "matched_topic", "kind", "topic", "rank",
        "target_negative_rate", "neighbors_negative_rate", "negative_rate_gap",
    )
    return (
        joined.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n", "rank")
    )


def _resolved_focus(questions: DataFrame, term_col: str) -> DataFrame:
    return resolve_topic(questions, term_col, topics=())


def evidence_for_terms(
    evidence: DataFrame, questions: DataFrame, term_col: str = "term", limit: int = 5
) -> DataFrame:
    """Evidence about the topic a term stands for, marked as own or as a neighbour's."""
    resolved = resolve_topic(questions, term_col)
    joined = resolved.join(
        evidence, (F.col("matched_topic") == F.col("topic")) & (resolved["property_id"] == evidence["property_id"])
    ).drop(evidence["property_id"])
    window = Window.partitionBy("property_id", term_col).orderBy(
        F.desc("topic_similarity"), "evidence_property_id", "review_idx", "sent_idx", "sentence_id"
    )
    own = F.col("evidence_property_id") == F.col("property_id")
    return (
        joined.dropDuplicates(["property_id", term_col, "sentence_id"])
        .withColumn("position", F.row_number().over(window))
        .filter(F.col("position") <= limit)
        .select(
            "property_id", term_col, "matched_topic", "position", "evidence_property_id",
            F.when(own, "YOUR PROPERTY").otherwise("NEIGHBOR").alias("source"),
            F.upper("sentiment_label").alias("sentiment"),
            F.substring("sentence_text", 1, 300).alias("quote"),
        )
    )
