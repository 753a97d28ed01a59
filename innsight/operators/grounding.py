"""How well responses are backed by the outputs they were written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import (
    GROUNDED_PATTERNS,
    NUMERIC_CLAIM_PATTERN,
    QUOTE_PATTERN,
    RISK_PATTERNS,
)
from innsight.functions import text as tx

CONTEXT_CHARS = 50
VALID_BELOW = 0.5
VALID_BELOW_STRICT = 0.2
BLOCK_ABOVE = 0.3


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _context(match: Column, text: Column) -> Column:
    """The first occurrence of a match with up to fifty characters on each side."""
    start = F.position(match, text) - 1
    first = F.greatest(F.lit(0), start - CONTEXT_CHARS)
    last = F.least(F.length(text), start + F.length(match) + CONTEXT_CHARS)
    return F.substr(text, first + 1, last - first)


def _repeated(amount: float, times: Column) -> Column:
    """``amount`` added up ``times`` times, in the order a running score adds it."""
    return F.aggregate(F.array_repeat(F.lit(amount), times), F.lit(0.0), lambda total, x: total + x)


def score_responses(
    responses: DataFrame, response_col: str = "response", outputs_col: str = "outputs", strict: bool = False
) -> DataFrame:
    """Add risk and validity columns to responses.

    ``outputs_col`` holds an array of the outputs a response rests on. The intermediate
    counts are kept as columns; everything is worked out within the row.
    """
    df = responses.withColumn("_low", F.lower(F.col(response_col)))
    df = df.withColumn("_evidence", F.lower(F.array_join(F.col(outputs_col), "\n")))
    df = df.withColumn("_words", tx.word_tokens(F.col("_evidence")))
    low, evidence, words = F.col("_low"), F.col("_evidence"), F.col("_words")

    risky = F.concat(*[_matches(low, p) for p in RISK_PATTERNS])
    df = df.withColumn("risk_phrases", F.size(risky))
    df = df.withColumn(
        "unsupported_phrases",
        F.size(F.filter(risky, lambda m: ~tx.fuzzy_contains(_context(m, low), evidence, words, 0.5))),
    )
    grounded = F.lit(0)
    for pattern in GROUNDED_PATTERNS:
        grounded = grounded + F.size(_matches(low, pattern))
    df = df.withColumn("grounded_phrases", grounded)

    quotes = F.regexp_extract_all(F.col(response_col), F.lit(QUOTE_PATTERN), F.lit(1))
    df = df.withColumn("quotes", F.size(quotes)).withColumn(
        "unsupported_quotes",
        F.size(F.filter(quotes, lambda q: ~tx.fuzzy_contains(F.lower(q), evidence, words, 0.7))),
    )
    numbers = F.regexp_extract_all(low, F.lit(NUMERIC_CLAIM_PATTERN), F.lit(1))
    df = df.withColumn("numeric_claims", F.size(numbers)).withColumn(
        "unsupported_numbers", F.size(F.filter(numbers, lambda n: ~F.contains(evidence, n)))
    )
    empty_handed = F.forall(
        F.col(outputs_col),
        lambda t: F.contains(F.lower(t), F.lit("no")) | (F.length(tx.strip(t)) < 50),
    )
    df = df.withColumn(
        "honest", (low.contains("no information found") | low.contains("not found")) & empty_handed
    )
    return _with_risk(df, strict).drop("_low", "_evidence", "_words")


def _with_risk(df: DataFrame, strict: bool) -> DataFrame:
    risk = _repeated(0.15, F.col("unsupported_phrases"))
    risk = F.when(
        F.col("grounded_phrases") > 0,
        F.greatest(F.lit(0.0), risk - F.col("grounded_phrases") * F.lit(0.05)),
    ).otherwise(risk)
    for amount, name in ((0.2, "unsupported_quotes"), (0.1, "unsupported_numbers")):
        risk = F.aggregate(F.array_repeat(F.lit(amount), F.col(name)), risk, lambda total, x: total + x)
    risk = F.when(F.col("honest"), F.greatest(F.lit(0.0), risk - F.lit(0.1))).otherwise(risk)
    limit = VALID_BELOW_STRICT if strict else VALID_BELOW
    return (
        df.withColumn("_risk", F.least(F.lit(1.0), risk))
        .withColumn("is_valid", F.col("_risk") < F.lit(limit))
        .withColumn("risk", F.round("_risk", 2))
        .withColumn("blocked", F.lit(strict) & (F.col("risk") > F.lit(BLOCK_ABOVE)))
        .drop("_risk")
    )
