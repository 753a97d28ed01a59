"""Tagging of sentences and reviews with topics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import TOPIC_ALIASES, TOPIC_KEYWORDS, TOPICS
from innsight.functions import text as tx

#: Bytes of topic vectors that may travel to the tasks, and scores that a task holds at once.
TOPIC_BYTES, SCORES = 256 << 20, 4_000_000

ASSIGNMENT_KEY = ("property_id", "sentence_id")
SENTENCE_COLUMNS = ("property_id", "review_idx", "sent_idx", "sentence_id", "sentiment_label", "sentence_text")


def best_topics(scores: np.ndarray, threshold: float, top_n: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, topics, scores) of each row's topics from ``threshold`` on, best first, ties by place."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :top_n]
    ranked = np.take_along_axis(scores, order, axis=1)
    good = ranked >= threshold
    offsets = np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32)
    return offsets, order[good], ranked[good]


def _scorer(shared: Broadcast, threshold: float, top_n: int | None):
    """Arrow function that replaces the vector, the last column, by the row's best topics."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        step = max(1, SCORES // max(1, len(names)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sentences = flatten_vectors(part.column(part.num_columns - 1))
                norms = np.linalg.norm(sentences, axis=1, keepdims=True)
                scores = np.round((sentences @ matrix.T) / np.where(norms > 0, norms, 1.0), 9)
                scores[norms[:, 0] == 0] = -np.inf
                offsets, topics, similarity = best_topics(scores, threshold, top_n)
                found = pa.StructArray.from_arrays(
                    [pa.array(names[topics], pa.string()), pa.array(similarity, pa.float64())], names=["topic", "topic_similarity"]
                )
                best = pa.ListArray.from_arrays(pa.array(offsets), found)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], best], names=[*part.schema.names[:-1], "_best"])

    return work


def topics_by_vector(
    sentences: DataFrame,
    topics: DataFrame,
    *,
    threshold: float = 0.35,
    top_n: int | None = 2,
    max_non_ascii: float = 0.20,
    partitions: int | None = None,
    vector_col: str = "vector",
    keep: Sequence[str] = ASSIGNMENT_KEY,
    english_col: str | None = None,
) -> DataFrame:
    """Best topics per sentence: ``(*keep, topic, topic_similarity)``.

    ``topics`` holds ``(topic, vector)``, any number of them whose vectors take up to 256 MB; they are
    broadcast once. A slice of sentences is scored against all topics in one product and only
    the best topics become rows, so the step needs no join, no shuffle and no loop over
    sentences. Sentences that are not English-like or have no vector are left out.
    Name all sentence columns in ``keep`` to get the enriched sentences straight away. Where the
    texts are not at hand, ``english_col`` tells which of them are English-like.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = topics.select("topic", vector.alias("vector")).where(F.exists("vector", lambda x: x != 0))
    held = usable.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    if held > TOPIC_BYTES:
        raise ValueError(f"topics: vectors of {held} bytes, more than {TOPIC_BYTES}")
    rows = sorted(usable.collect(), key=lambda r: r["topic"])
    matrix = np.array([r["vector"] for r in rows], dtype=float)
    if len(rows):
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    names = np.array([r["topic"] for r in rows], dtype=object)
    shared = sentences.sparkSession.sparkContext.broadcast((names, matrix))

    english = F.col(english_col) if english_col else tx.english_like(F.col("sentence_text"), max_non_ascii)
    base = sentences.filter(english & F.col(vector_col).isNotNull())
    if partitions is not None:
        base = base.repartition(partitions)
    given = base.select(*keep, vector.alias("_vector"))
    if not rows:
        return given.select(*keep, F.lit("").alias("topic"), F.lit(0.0).alias("topic_similarity")).limit(0)
    kinds = ", ".join([
        *[f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_vector"],
        "_best array<struct<topic: string, topic_similarity: double>>",
    ])
    return given.mapInArrow(_scorer(shared, float(threshold), top_n), kinds).select(*keep, F.inline("_best"))


def topics_by_keyword(
    sentences: DataFrame, keywords: dict[str, Sequence[str]], *, top_n: int | None = 2,
    max_non_ascii: float = 0.20, keep: Sequence[str] = ASSIGNMENT_KEY, text_col: str = "sentence_text",
) -> DataFrame:
    """Best topics per sentence, the similarity being the share of a topic's keywords it holds."""
    text = F.col("_text")
    scored = F.array(
        *[
            F.struct(
                (-tx.count_found(text, words) / F.lit(len(words))).alias("minus"),
                F.lit(topic).alias("topic"),
            )
            for topic, words in keywords.items()
        ]
    )
    best = F.array_sort(F.filter(scored, lambda s: s["minus"] < 0))
    best = best if top_n is None else F.slice(best, 1, top_n)
    # lower case and scores are columns of their own: a generator would work them out per use;
    # the outer one, since Spark puts the whole of an inner one's scores into a filter below it as well
    return (
        sentences.filter(tx.english_like(F.col(text_col), max_non_ascii))
        .withColumn("_text", F.lower(F.col(text_col)))
        .select(*keep, best.alias("_best"))
        .select(*keep, F.inline_outer("_best"))
        .where(F.col("topic").isNotNull())
        .select(*keep, "topic", (-F.col("minus")).alias("topic_similarity"))
    )


def query_keywords(
    queries: DataFrame, query_col: str = "query", groups: dict[str, Sequence[str]] = TOPIC_KEYWORDS
) -> DataFrame:
    """Append ``keywords``: the groups a query touches, and the query's own words."""
    query = F.lower(F.col(query_col))
    parts = [
        F.when(query.contains(key) | tx.contains_any(query, words), tx.word_array(words)).otherwise(
            F.array().cast("array<string>")
        )
        for key, words in groups.items()
    ]
    own = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    return queries.withColumn("keywords", F.array_distinct(F.concat(*parts, own)))


def mentions_keyword(text: Column, keywords: Column) -> Column:
    """True when one of the keywords is in the text.

    The lower-case text rides in the accumulator: named in the function itself, it would be
    worked out anew for every keyword.
    """
    start = F.struct(F.lower(text).alias("text"), F.lit(False).alias("hit"))
    return F.aggregate(
        keywords,
        start,
        lambda seen, word: F.struct(
            seen["text"].alias("text"), (seen["hit"] | F.contains(seen["text"], word)).alias("hit")
        ),
        lambda seen: seen["hit"],
    )


def resolve_topic(
    terms: DataFrame, term_col: str = "term", topics: Sequence[str] = tuple(TOPICS),
    aliases: dict[str, str] = TOPIC_ALIASES,
) -> DataFrame:
    """Append ``matched_topic``: the alias of the term, else the first topic containing it, else the term."""
    term = tx.strip(F.lower(F.col(term_col)))
    alias = F.element_at(
        F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair]), term
    )
    containing = F.filter(tx.word_array(topics), lambda topic: F.contains(topic, term))
    return terms.withColumn(
        "matched_topic", F.coalesce(alias, F.get(containing, F.lit(0)), F.col(term_col))
    )


def flatten_vectors(batch: pa.ListArray) -> np.ndarray:
    """Vectors of an Arrow list column as one matrix, one row per vector."""
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
