"""Sentence boundaries learnt from the corpus: which full stops end a sentence.

A word that nearly always stands with a full stop is an abbreviation; a likelihood ratio against
the corpus' rate of full stops says how surely, and short words with inner stops count more (the
unsupervised statistics of Kiss and Strunk, 2006). Words that follow a number with a full stop
more often than others make it an ordinal. Both are sums over all texts; the splitter then works
on each text alone and needs no upper case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.operators.sentences import sentence_id
from innsight.sources.shared import collect_small, stored

#: Published constants of the statistics: rate of a stop after an abbreviation, least score, least ratio.
ABBREVIATION_RATE, LEAST_SCORE, LEAST_RATIO = 0.99, 0.3, 7.88
#: Marks that may stand around a word.
OPENING, CLOSING = "\"'([{«„“‚‘", "\"')]}»“”’"
MAX_LEARNT = 1_000_000

_BARE = rf"^[{re.escape(OPENING)}]+|[{re.escape(CLOSING)},;:]+$"
_WORD = r"^\p{L}[\p{L}.'-]*$"
_NUMBER = r"^[0-9]+\.$"


@dataclass(frozen=True)
class Boundaries:
    """What a splitter has to know; words are lower-case and without their last stop."""

    abbreviations: frozenset[str] = field(default_factory=frozenset)
    after_numbers: frozenset[str] = field(default_factory=frozenset)


def _tokens(text: Column) -> Column:
    split = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.regexp_replace(t, _BARE, ""))
    return F.filter(split, lambda t: t != "")


def _word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``(type, with_stop, without_stop, after, n)`` of all words, from one pass over the texts."""
    tokens = texts.select(_tokens(F.col(text_col)).alias("t"))
    pairs = F.transform("t", lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get("t", i - 1).rlike(_NUMBER), F.lit(False)).alias("after")))
    word = tokens.select(F.inline(pairs)).where(F.col("t").rlike(_WORD))
    stop = F.col("t").endswith(".")
    return word.groupBy(F.regexp_replace("t", r"\.$", "").alias("type")).agg(
        F.count_if(stop).alias("with_stop"), F.count_if(~stop).alias("without_stop"),
        F.count_if("after").alias("after"), F.count("*").alias("n"),
    )


def type_counts(texts: DataFrame, text_col: str = "review_text") -> DataFrame:
    """``(type, with_stop, without_stop)`` of all words, lower-case, without marks around them."""
    token = texts.select(F.explode(_tokens(F.col(text_col))).alias("t")).where(F.col("t").rlike(_WORD))
    stop = F.col("t").endswith(".")
    plain = F.when(stop, F.regexp_replace("t", r"\.$", "")).otherwise(F.col("t"))
    return token.groupBy(plain.alias("type")).agg(F.count_if(stop).alias("with_stop"), F.count_if(~stop).alias("without_stop"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """The counts of words seen with a stop, with ``ratio`` and ``score``.

    ``ratio`` is twice the log-likelihood of the word as an abbreviation over the word as any
    other; ``score`` weighs it by length, inner stops and occurrences without a stop.
    """
    whole = counts.agg(F.sum("with_stop").alias("s"), F.sum(F.col("with_stop") + F.col("without_stop")).alias("n")).first()
    rate = (whole["s"] or 0) / whole["n"] if whole["n"] else 0.0
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    a, b = F.col("with_stop").cast("double"), F.col("without_stop").cast("double")
    ratio = 2 * (
        a * (F.log(F.lit(ABBREVIATION_RATE)) - F.log(F.lit(rate))) + b * (F.log(F.lit(1 - ABBREVIATION_RATE)) - F.log(F.lit(1 - rate)))
    )
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    scored = counts.where("with_stop > 0").withColumn("ratio", ratio)
    return scored.withColumn("score", F.col("ratio") * F.exp(-letters) * (inner + 1) * F.pow(letters, -b))


def after_number_counts(texts: DataFrame, text_col: str = "review_text") -> DataFrame:
    """``(type, after, n)``: how often a word follows a number with a full stop, and at all."""
    return _word_counts(texts, text_col).select("type", "after", "n")


def after_number_ratios(counts: DataFrame) -> DataFrame:
    """Words that follow numbers with a stop more often than chance has it, with the likelihood ratio."""
    whole = counts.agg(F.sum("after").alias("a"), F.sum("n").alias("n")).first()
    a_all, n_all = float(whole["a"] or 0), float(whole["n"] or 0)

    def likelihood(hits: Column, of: Column, rate: Column) -> Column:
        held = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), rate))
        return hits * F.log(held) + (of - hits) * F.log(1 - held)

    a, n = F.col("after").cast("double"), F.col("n").cast("double")
    common = F.lit(a_all / n_all if n_all else 0.0)
    rest = (F.lit(a_all) - a) / F.greatest(F.lit(n_all) - n, F.lit(1.0))
    apart = likelihood(a, n, a / n) + likelihood(F.lit(a_all) - a, F.lit(n_all) - n, rest)
    same = likelihood(a, n, common) + likelihood(F.lit(a_all) - a, F.lit(n_all) - n, common)
    return counts.where("after > 0").where(a / n > common).withColumn("ratio", 2 * (apart - same))


def learn(texts: DataFrame, text_col: str = "review_text") -> Boundaries:
    """The abbreviations and words after ordinals of a corpus. Null texts are none.

    The texts are read once; both statistics and their sums come from the stored counts. What
    comes to the driver are words of languages, not of rows: over a million are refused.
    """
    counts = stored(_word_counts(texts, text_col), "word-counts")
    scored = abbreviation_scores(counts.select("type", "with_stop", "without_stop")).where(F.col("score") >= LEAST_SCORE).select("type")
    after = after_number_ratios(counts.select("type", "after", "n")).where(F.col("ratio") >= LEAST_RATIO).select("type")
    return Boundaries(
        frozenset(r["type"] for r in collect_small(scored, MAX_LEARNT, "abbreviations")),
        frozenset(r["type"] for r in collect_small(after, MAX_LEARNT, "words after ordinals")),
    )


_ENDS = re.compile(rf"[.!?…]+[{re.escape(CLOSING)}]*$")


def split_text(text: str, known: Boundaries) -> list[str]:
    """The sentences of a text, blanks between them left out.

    A word with a stop ends no sentence when it is an abbreviation, a single letter, or a number
    before a word that ordinals go with. Decimals and inner stops have no blank behind them.
    """
    words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", text)]
    out, start = [], None
    for i, (at, end, word) in enumerate(words):
        start = at if start is None else start
        if i + 1 < len(words) and not _ENDS.search(word):
            continue
        bare = word.lower().lstrip(OPENING).rstrip(CLOSING + ",;:")
        if i + 1 < len(words) and bare.endswith(".") and not bare.endswith(".."):
            plain, after = bare[:-1], words[i + 1][2].lower().lstrip(OPENING).rstrip(CLOSING + ",;:!?").removesuffix(".")
            initial = len(plain) == 1 and plain.isalpha()
            if initial or plain in known.abbreviations or (plain.isdigit() and after in known.after_numbers):
                continue
        out.append(text[start:end])
        start = None
    return out


def split_learnt(reviews: DataFrame, known: Boundaries, keep: Sequence[str] = (), text_col: str = "review_text") -> DataFrame:
    """One row per sentence, as ``sentences.split_sentences`` gives them, cut at learnt boundaries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            cut = pa.array([split_text(t, known) if t else [] for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cut], names=[*batch.schema.names, "_cut"])

    rows = reviews.select("property_id", "review_idx", *keep, F.col(text_col).alias("_text"))
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "_cut array<string>"])
    spread = rows.mapInArrow(work, kinds).select(
        "property_id", "review_idx", *keep, F.posexplode("_cut").alias("sent_idx", "sentence_text")
    )
    return spread.withColumn(
        "sentence_id", sentence_id(F.col("property_id"), F.col("review_idx"), F.col("sent_idx"), F.col("sentence_text"))
    ).select("property_id", "review_idx", "sent_idx", "sentence_id", "sentence_text", *keep)
