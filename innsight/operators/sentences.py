"""Reviews to sentences, with sentiment labels and sentence vectors."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    HashingTF,
    IndexToString,
    RegexTokenizer,
    StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions import text as tx
from innsight.functions.reviews import json_reviews
from innsight.operators.neighbours import members

_TOKEN = r"[\p{L}\p{N}_]+"

# Words of the rule-based labeller; callers with their own domain pass other lists.
POSITIVE_WORDS = [
    "clean", "comfortable", "cozy", "friendly", "great", "helpful", "lovely", "peaceful",
    "perfect", "quiet", "recommend", "spacious", "spotless", "wonderful",
]
NEGATIVE_WORDS = [
    "bad", "broken", "cold", "dirty", "dust", "loud", "noisy", "poor", "rude", "slow",
    "small", "smell", "stain", "terrible",
]


def explode_reviews(
    listings: DataFrame, id_col: str = "property_id", reviews_col: str = "reviews",
    max_reviews: int | None = None,
) -> DataFrame:
    """One row per review of the JSON array: ``(property_id, review_idx, review_text)``.

    ``max_reviews`` keeps the first reviews of each listing; by default all are kept.
    """
    parsed = listings.select(
        F.col(id_col).cast("string").alias("property_id"),
        F.posexplode_outer(json_reviews(F.col(reviews_col), max_reviews)).alias(
            "review_idx", "review_text"
        ),
    )
    return parsed.filter(F.col("review_text").isNotNull()).withColumn(
        "review_text", tx.normalise_review(F.col("review_text"))
    )


def sentence_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("||", *[p.cast("string") for p in parts]), 256)


def split_sentences(reviews: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-empty sentence, numbered within its review, with a content id.

    ``keep`` names review columns to carry along.
    """
    exploded = reviews.select(
        "property_id",
        "review_idx",
        *keep,
        F.posexplode(tx.sentences(F.col("review_text"))).alias("sent_idx", "sentence_text"),
    ).filter(F.length("sentence_text") > 0)
    return exploded.withColumn(
        "sentence_id",
        sentence_id(F.col("property_id"), F.col("review_idx"), F.col("sent_idx"), F.col("sentence_text")),
    ).select("property_id", "review_idx", "sent_idx", "sentence_id", "sentence_text", *keep)


def lexicon_sentiment(
    sentences: DataFrame, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS,
    text_col: str = "sentence_text",
) -> DataFrame:
    """Label by the balance of positive and negative words; ``na`` when they balance."""
    text = F.lower(F.col(text_col))

    def hits(words: list[str]) -> Column:
        listed = "|".join(re.escape(w) for w in words)
        return F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{listed})(?![\p{{L}}\p{{N}}_])"))

    return (
        sentences.withColumn("_balance", hits(positive) - hits(negative))
        .withColumn(
            "sentiment_label",
            F.when(F.col("_balance") > 0, "positive").when(F.col("_balance") < 0, "negative").otherwise("na"),
        )
        .drop("_balance")
    )


def fit_sentiment(
    labelled: DataFrame, text_col: str = "sentence_text", label_col: str = "sentiment_label",
    dims: int = 1 << 16,
) -> PipelineModel:
    """Naive Bayes over hashed words, trained on a table of labelled texts."""
    indexer = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc")
    indexed = indexer.fit(labelled)
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=_TOKEN, gaps=False),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims),
            NaiveBayes(featuresCol="_counts", labelCol="_label", predictionCol="_predicted"),
            IndexToString(inputCol="_predicted", outputCol="_sentiment", labels=indexed.labels),
        ]
    ).fit(indexed.transform(labelled))


def apply_sentiment(sentences: DataFrame, model: PipelineModel) -> DataFrame:
    keep = [c for c in sentences.columns if c != "sentiment_label"]
    return model.transform(sentences).select(*keep, F.col("_sentiment").alias("sentiment_label"))


def fit_embedding(texts: DataFrame, text_col: str = "sentence_text", dims: int = 512) -> PipelineModel:
    """Hashed word counts weighted by inverse document frequency, fitted on ``texts``."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=_TOKEN, gaps=False),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims),
            IDF(inputCol="_counts", outputCol="_vector"),
        ]
    ).fit(texts)


def vocabulary_embedding(spark, vocabulary: list[str], text_col: str = "sentence_text") -> PipelineModel:
    """Word counts over a fixed vocabulary; nothing to fit."""
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_words", outputCol="_vector")
    return PipelineModel(
        stages=[RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=_TOKEN, gaps=False), counter]
    )


def embed(
    texts: DataFrame, model: PipelineModel, text_col: str = "sentence_text", output: str = "vector"
) -> DataFrame:
    """Append the model's vector as ``array<double>``."""
    renamed = model.transform(texts)
    return renamed.select(*texts.columns, vector_to_array("_vector").alias(output))


def distinct_sentences(sentences: DataFrame) -> DataFrame:
    """Distinct sentences per property."""
    return sentences.groupBy("property_id").agg(
        F.count_distinct("sentence_id").alias("distinct_sentences")
    )


def sentence_volume(sentences: DataFrame, neighbours: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Distinct sentences of each target and of all its neighbours together."""
    volume = distinct_sentences(sentences).withColumnRenamed("property_id", "member_id")
    joined = members(neighbours, targets).join(volume, "member_id", "left")

    def of(side: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("distinct_sentences"))), F.lit(0))

    return joined.groupBy("property_id").agg(
        of("target").alias("target_distinct_sentences_used"),
        of("neighbors").alias("neighbors_distinct_sentences_used"),
    )
