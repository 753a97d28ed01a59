"""Naive Bayes sentiment from plain sums: words with negation scope, chosen by mutual information.

A word that follows a negation within its clause is a feature of its own (``not_clean``). Features
whose presence tells the labels apart (the likelihood ratio of independence, twice the mutual
information times the number of texts) make up the model, which is a table; training and applying
are joins and sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.sources.shared import collect_small, stored

CLAUSE = r"[.,;:!?\n]+"
WORD = r"[\p{L}\p{N}_']+"
#: Words that turn what follows them in their clause, in four languages.
NEGATIONS = (
    "not", "no", "never", "nothing", "without", "cannot", "can't", "don't", "doesn't", "didn't", "isn't", "wasn't", "aren't",
    "weren't", "won't", "wouldn't", "couldn't", "shouldn't", "hasn't", "haven't", "nicht", "kein", "keine", "keinen", "nie", "ohne",
    "ne", "pas", "jamais", "sans", "nunca", "sin", "jamás",
)
#: The 1 % point of the chi-squared distribution with one degree of freedom.
LEAST_RATIO = 6.635


def features(text: Column) -> Column:
    """Words of a text; those after the first negation of their clause with ``not_`` before them."""

    def clause(part: Column) -> Column:
        def marked(words: Column) -> Column:
            first = F.array_min(F.transform(words, lambda w, i: F.when(w.isin(*NEGATIONS), i)))
            return F.transform(words, lambda w, i: F.when(i > first, F.concat(F.lit("not_"), w)).otherwise(w))

        return F.flatten(F.transform(F.array(F.regexp_extract_all(part, F.lit(WORD), F.lit(0))), marked))

    return F.flatten(F.transform(F.split(F.lower(text), CLAUSE), clause))


def _counts(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``(feature, label, n, texts)``; the null feature counts each label's texts."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).alias("label"), features(F.col(text_col)).alias("features")
    )
    whole = F.array(F.struct(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("n"), F.lit(1).alias("texts")))
    once = F.transform(F.array_distinct("features"), lambda f: F.struct(f.alias("feature"), F.lit(0).alias("n"), F.lit(1).alias("texts")))
    every = F.transform("features", lambda f: F.struct(f.alias("feature"), F.lit(1).alias("n"), F.lit(0).alias("texts")))
    return rows.select("label", F.inline(F.concat(whole, once, every))).groupBy("feature", "label").agg(
        F.sum("n").alias("n"), F.sum("texts").alias("texts")
    )


def feature_counts(labelled: DataFrame, text_col: str = "sentence_text", label_col: str = "sentiment_label") -> DataFrame:
    """``(feature, label, n, texts)``: occurrences and texts of every feature under every label."""
    return _counts(labelled, text_col, label_col).where("feature is not null")


def label_counts(labelled: DataFrame, text_col: str = "sentence_text", label_col: str = "sentiment_label") -> dict[str, int]:
    """Labelled texts per label; labels are a handful, and more than a thousand are refused."""
    counted = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(label_col).alias("label")).agg(
        F.count("*").alias("n")
    )
    return {r["label"]: r["n"] for r in sorted(collect_small(counted, 1000, "labels"))}


def _by_label(counts: DataFrame, features: DataFrame, labels: dict[str, int]) -> DataFrame:
    """One row per feature and label, counts of 0 where they never met."""
    each = F.array(*[F.struct(F.lit(name).alias("label"), F.lit(n).alias("of_label")) for name, n in labels.items()])
    grid = features.select("*", F.inline(each))
    return grid.join(counts, ["feature", "label"], "left").na.fill(0, ["n", "texts"])


def chosen_features(counts: DataFrame, labels: dict[str, int], least: float = LEAST_RATIO) -> DataFrame:
    """``(feature, ratio)`` of the features whose presence depends on the label."""
    if not labels:
        return counts.select("feature", F.lit(0.0).alias("ratio")).limit(0)
    of_all = F.lit(float(sum(labels.values())))
    rows = _by_label(counts, counts.groupBy("feature").agg(F.sum("texts").alias("having")), labels)

    def part(joint: Column, side: Column) -> Column:
        return F.when(joint > 0, joint * F.log(joint * of_all / (side * F.col("of_label")))).otherwise(0.0)

    present = part(F.col("texts").cast("double"), F.col("having"))
    absent = part((F.col("of_label") - F.col("texts")).cast("double"), of_all - F.col("having"))
    return rows.groupBy("feature").agg((2 * F.sum(present + absent)).alias("ratio")).where(F.col("ratio") >= least)


def fit(
    labelled: DataFrame, text_col: str = "sentence_text", label_col: str = "sentiment_label", least: float = LEAST_RATIO
) -> tuple[DataFrame, dict[str, float]]:
    """``(feature, label, weight)`` and the labels' priors: logarithms, counts smoothed by one.

    The texts are read once; features are chosen and weighed from their stored counts, and the
    weights are a stored table as well.
    """
    every = stored(_counts(labelled, text_col, label_col), "feature-counts")
    counts = every.where("feature is not null")
    sizes = collect_small(every.where("feature is null").select("label", "texts"), 1000, "labels")
    labels = {r["label"]: r["texts"] for r in sorted(sizes)}
    if not labels:
        raise ValueError("no labelled text to learn from")
    grid = _by_label(counts, chosen_features(counts, labels, least).select("feature"), labels)
    totals = grid.groupBy("label").agg((F.sum("n") + F.count("*")).alias("of_words"))  # a row per label
    weights = grid.join(totals, "label").select(
        "feature", "label", F.log((F.col("n") + 1).cast("double") / F.col("of_words")).alias("weight")
    )
    whole = sum(labels.values())
    return stored(weights, "word-weights"), {name: math.log(n / whole) for name, n in labels.items()}


def apply(
    texts: DataFrame, model: tuple[DataFrame, dict[str, float]], keys: Sequence[str], text_col: str = "sentence_text",
    output: str = "sentiment_label",
) -> DataFrame:
    """Texts with the likeliest label; ties go to the lesser label, texts without known features to the commonest.

    ``keys`` tell rows apart; equal rows get one label. Scores are compared at nine digits.
    """
    weights, priors = model
    names = sorted(priors)
    per_feature = weights.groupBy("feature").agg(
        *[F.max(F.when(F.col("label") == name, F.col("weight"))).alias(f"w{i}") for i, name in enumerate(names)]
    )
    spread = texts.dropDuplicates(list(keys)).select(*keys, F.explode(features(F.col(text_col))).alias("feature"))
    sums = spread.join(per_feature, "feature").groupBy(*keys).agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(names))])
    scored = F.array_min(F.array(*[
        F.struct((-F.round(F.coalesce(F.col(f"w{i}"), F.lit(0.0)) + priors[name], 9)).alias("order"), F.lit(name).alias("label"))
        for i, name in enumerate(names)
    ]))
    columns = [c for c in texts.columns if c != output]
    return texts.join(sums, list(keys), "left").select(*columns, scored["label"].alias(output))
