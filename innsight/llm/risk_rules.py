"""Quality rules whose cutoffs are chosen on labelled documents with a proven false-rejection rate.

One path of strictness tightens all rules together: a text's level is the largest of its shares,
each measured against the share at which its rule is mildest. Among the texts labelled good, the
share a level rejects is bounded from above by the exact binomial (Clopper-Pearson) bound. Levels
are tested from the mildest to the strictest, each only after the one before has passed, so
neither rules nor levels cost a correction; the strata share the error by Bonferroni.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.work import stored, within

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]"
#: name -> (numerator, denominator, share in percent at which the rule is mildest).
RULES = {
    "symbols": ("n_symbols", "word_chars", 50),
    "repeats": ("n_repeat_words", "n_words", 50),
    "dup_lines": ("n_dup_lines", "n_lines", 100),
    "capitals": ("n_capitals", "word_chars", 100),
    "marks": ("n_marks", "word_chars", 50),
}


@dataclass(frozen=True)
class Risk:
    """At most ``rate`` of the good texts of a stratum are rejected, with certainty ``1 - error``."""

    rate: float = 0.01
    error: float = 0.05
    grid: int = 100


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The frame with the numbers the rules look at; a null text counts as empty.

    Words are runs of anything but ASCII blanks. ``n_repeat_words`` counts words in 3-word
    windows that occur at least twice: windows are hashed, sorted with their places, and equal
    neighbours marked, all within the row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        *kept,
        text.alias("_text"),
        F.filter(F.split(text, BLANKS), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    windows = F.transform(
        F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(
            F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")
        ),
    )
    rows = rows.withColumn("_sorted", F.sort_array(windows))
    twice = F.transform(
        F.filter(
            "_sorted",
            lambda x, i: F.coalesce(x.h == F.get("_sorted", i - 1).h, F.lit(False))
            | F.coalesce(x.h == F.get("_sorted", i + 1).h, F.lit(False)),
        ),
        lambda x: x.p,
    )
    rows = rows.withColumn("_twice", F.sort_array(twice))
    covered = F.aggregate(
        F.transform("_twice", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_twice", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    plain = F.regexp_replace("_text", BLANKS, "")
    rows = rows.withColumn("n_repeat_words", covered).withColumn("_plain", plain)
    found = F.struct(
        "n_words",
        F.char_length("_plain").cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_plain", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace("_plain", "[^A-Z]", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace("_plain", "[^!?]", "")).cast("long").alias("n_marks"),
    )
    # a generator of one row: filters on the numbers stay above it and do not repeat the work
    return rows.select(*kept, F.inline(F.array(found)))


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def level(grid: int) -> Column:
    """How strict the path has to be to reject a text: 0 to ``grid``, the mildest; a share of nothing is 0."""
    steps = [
        F.when(F.col(bottom) > 0, F.expr(f"({top} * {100 * grid}L) div ({bottom} * {mildest}L)")).otherwise(0)
        for top, bottom, mildest in RULES.values()
    ]
    return F.least(F.lit(grid), F.greatest(*steps)).cast("int")


def most_rejected(n: Column, rate: float, error: Column) -> Column:
    """The largest count k whose exact upper bound at ``n`` trials is within ``rate``; -1 if none.

    That is the largest k with ``P(Binomial(n, rate) <= k) <= error``, for errors below one half:
    then k is below the mean, and ``n * rate`` terms are added up, in logarithms.
    """
    odds = F.log(F.lit(rate)) - F.log1p(F.lit(-rate))
    none = n * F.log1p(F.lit(-rate))
    start = F.struct(
        none.alias("log_p"), F.exp(none).alias("total"), F.when(F.exp(none) <= error, 0).otherwise(-1).cast("long").alias("k")
    )

    def step(s: Column, j: Column) -> Column:
        log_p = s.log_p + F.log((n - j + 1) / j) + odds
        total = s.total + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.when(total <= error, j).otherwise(s.k).alias("k"))

    counts = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.ceil(n * rate)).cast("long"))
    return F.when(n > 0, F.aggregate(counts, start, step, lambda s: s.k)).otherwise(F.lit(-1).cast("long"))


def cutoffs(holdout: DataFrame, stratum: str, good: str, risk: Risk = Risk()) -> DataFrame:
    """(stratum, n_good, allowed, cutoff): per stratum the lowest level from which a text is rejected.

    ``holdout`` holds measured and labelled rows; only those whose label is 1 and that pass the
    base rules bear on false rejection, all of them. They are counted by stratum and level, at
    most ``grid + 1`` rows a stratum; only the number of strata reaches the driver. Without enough
    good texts to prove anything a stratum has no cutoff (null) and rejects nothing.
    """
    counted = stored(
        holdout.where((F.col(good) == 1) & ~base_failed())
        .groupBy(F.col(stratum).alias("stratum"), level(risk.grid).alias("level")).agg(F.count("*").alias("n")),
        "levels",
    )
    strata = counted.groupBy("stratum").agg(F.sum("n").alias("n_good"))
    error = F.lit(risk.error / max(1, strata.count()))
    # rows a level rejects: those at it or above; a level passes if it and all milder ones do
    above = F.expr("sum(n) over (partition by stratum order by level desc)")
    named = strata.withColumn("allowed", most_rejected(F.col("n_good"), risk.rate, error)).withColumnRenamed("stratum", "_s")
    tested = counted.where("level > 0").withColumn("rejected", above).join(named, F.expr("stratum <=> _s"), "right")
    # the strictest level is one above the mildest level seen that rejects too many
    failing = F.coalesce(F.max(F.when(F.col("rejected") > F.col("allowed"), F.col("level"))), F.lit(0))
    found = tested.groupBy(F.col("_s").alias("stratum"), "n_good", "allowed").agg((failing + 1).alias("cutoff"))
    proven = (F.col("allowed") >= 0) & (F.col("cutoff") <= risk.grid)
    return stored(found.withColumn("cutoff", F.when(proven, F.col("cutoff"))), "cutoffs")


def judged_measures(measured: DataFrame, cuts: DataFrame, risk: Risk = Risk(), stratum_col: str = "lang") -> DataFrame:
    """Measured rows with ``base_failed`` and ``kept``; ``cuts`` has one row a stratum."""
    limit = cuts.where("cutoff is not null").select(F.col("stratum").alias("_s"), F.col("cutoff").alias("_cutoff"))
    rows = measured.withColumn("base_failed", base_failed()).withColumn("_level", level(risk.grid))
    met = rows.join(limit, rows[stratum_col].eqNullSafe(limit["_s"]), "left")
    passed = F.col("_cutoff").isNull() | (F.col("_level") < F.col("_cutoff"))
    return met.withColumn("kept", ~F.col("base_failed") & passed).drop("_s", "_cutoff", "_level")


def labelled_good(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(_id, _good): one row per labelled document, good if any of its labels is 1."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_good"))


def judged(
    docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text",
    stratum_col: str = "lang", label_col: str = "quality",
) -> DataFrame:
    """All columns of ``docs`` with the measures, ``base_failed`` and ``kept``.

    Strata are the values of ``stratum_col`` (null is one of its own). A document labelled
    several times is good if any of its labels is 1; labels without a document or a value are
    ignored. Null and empty texts have no words and fail the base rules. Repeated rows are
    judged alike. An empty table gives an empty result; without labels only the base rules
    hold. Result columns replace columns of the same name.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks",
           "base_failed", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c in new and c not in (id_col, text_col, stratum_col)])
    # only texts that may be labelled are measured for the cutoffs
    good = labelled_good(labels, id_col, label_col)
    asked = within(docs.select(id_col, text_col, stratum_col), id_col, good, "_id")
    numbers = measures(asked, text_col).drop(text_col).withColumn("_stratum", F.col(stratum_col))
    cuts = cutoffs(numbers.join(good, numbers[id_col] == good["_id"]), "_stratum", "_good", risk)
    return judged_measures(measures(docs, text_col), cuts, risk, stratum_col)
