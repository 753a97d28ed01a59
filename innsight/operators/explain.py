"""Elastic-net rating model and what it says about each property."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import MARKET_TRENDS
from innsight.functions import text as tx

BENCHMARK_QUANTILE = 0.8
QUANTILE_ACCURACY = 10_000


def feature_stages(
    numerics: Sequence[str], categoricals: Sequence[str], median_error: float = 0.001
) -> list:
    """Median imputation, one-hot encoding and standardisation to ``features_scaled``."""
    imputed = [f"{c}__imp" for c in numerics]
    stages = [
        Imputer(strategy="median", inputCols=list(numerics), outputCols=imputed, relativeError=median_error)
    ]
    encoded = [f"{c}__ohe" for c in categoricals]
    if categoricals:
        indexed = [f"{c}__idx" for c in categoricals]
        stages.append(StringIndexer(inputCols=list(categoricals), outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"))
    return stages + [
        VectorAssembler(inputCols=imputed + encoded, outputCol="features_vec", handleInvalid="keep"),
        StandardScaler(inputCol="features_vec", outputCol="features_scaled", withMean=True, withStd=True),
    ]


def rating_pipeline(numerics: Sequence[str], categoricals: Sequence[str], label_col: str = "ratings") -> Pipeline:
    """The feature stages and an elastic-net regression."""
    regression = LinearRegression(
        featuresCol="features_scaled", labelCol=label_col, maxIter=50, regParam=0.1, elasticNetParam=0.5
    )
    return Pipeline(stages=[*feature_stages(numerics, categoricals), regression])


def vector_names(scored: DataFrame) -> list[str]:
    """Names of the entries of ``features_vec``, in order."""
    groups = scored.schema["features_vec"].metadata["ml_attr"]["attrs"]
    attributes = sorted((a for group in groups.values() for a in group), key=lambda a: a["idx"])
    return [a["name"] for a in attributes]


def long_vectors(scored: DataFrame, id_col: str = "property_id") -> DataFrame:
    """Standardised features as rows: ``(property_id, feature, value)``."""
    names = F.array(*[F.lit(n) for n in vector_names(scored)])
    zipped = F.arrays_zip(names.alias("feature"), vector_to_array("features_scaled").alias("value"))
    return scored.select(F.col(id_col).alias("property_id"), F.inline(zipped))


def training_rows(df: DataFrame, label_col: str = "ratings", leave_out: str | None = None,
                  id_col: str = "property_id") -> DataFrame:
    """Rows with a label, without the property that is to be explained."""
    rows = df.filter(F.col(label_col).isNotNull())
    return rows if leave_out is None else rows.filter(F.col(id_col) != F.lit(leave_out))


def benchmark(
    train: DataFrame, label_col: str, numerics: Sequence[str], categoricals: Sequence[str] = (),
    keys: Sequence[str] = (), quantile: float = BENCHMARK_QUANTILE,
) -> DataFrame:
    """Means and modes over the top fifth by label: one row per key, or one in all.

    The threshold is a sketch merged from every partition; the rows are filtered against it
    and aggregated, nothing is sorted.
    """
    keys = list(keys)
    threshold = F.percentile_approx(label_col, quantile, QUANTILE_ACCURACY).alias("threshold")
    aggregates = [
        F.count("*").alias("n_benchmark"),
        *[F.avg(c).alias(c) for c in numerics],
        *[F.coalesce(F.mode(c, True), F.lit("unknown")).alias(c) for c in categoricals],
    ]
    if keys:
        marked = train.join(train.groupBy(*keys).agg(threshold), keys)
    else:
        value = train.agg(threshold).first()["threshold"]
        marked = train.withColumn("threshold", F.lit(value).cast("double"))
    top = marked.filter(F.col(label_col) >= F.col("threshold"))
    return top.groupBy(*keys, "threshold").agg(*aggregates)


@dataclass(frozen=True)
class Slot:
    """One entry of the feature vector."""

    name: str
    coef: float
    top_scaled: float
    top_value: float | None


def vector_slots(model: PipelineModel, benchmark_row: DataFrame, numerics: Sequence[str]) -> list[Slot]:
    """Names, coefficients and benchmark values of the feature vector: one entry per column."""
    scored = model.transform(benchmark_row)
    row = scored.select(vector_to_array("features_scaled").alias("scaled"), *numerics).first()
    raw = {f"{c}__imp": row[c] for c in numerics}
    return [
        Slot(name, float(coef), float(scaled), raw.get(name))
        for name, coef, scaled in zip(
            vector_names(scored), model.stages[-1].coefficients, row["scaled"], strict=True
        )
    ]


def market_trend(coef: Column) -> Column:
    good, bad, neutral = MARKET_TRENDS
    return F.when(coef > 0, good).when(coef < 0, bad).otherwise(neutral)


def insight_share(insights: DataFrame, keys: Sequence[str] = ("property_id",)) -> DataFrame:
    """Impact, gain and share of the total impact of features given as rows.

    Needs ``feature, coef, target_scaled, top_scaled`` per key.
    """
    impact = F.col("coef") * F.col("target_scaled")
    rows = insights.withColumn("impact_value", impact).withColumn("abs_impact", F.abs("impact_value"))
    totals = rows.groupBy(*keys).agg(F.sum("abs_impact").alias("_total"))
    total = F.when(F.coalesce("_total", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_total"))
    return (
        rows.join(totals, list(keys))
        .withColumn("potential_gain_scaled", F.col("coef") * (F.col("top_scaled") - F.col("target_scaled")))
        .withColumn("impact_pct_abs", F.col("abs_impact") / total * 100)
        .withColumn("market_trend", market_trend(F.col("coef")))
        .drop("_total")
    )


def explain(
    df: DataFrame, model: PipelineModel, slots: Sequence[Slot], numerics: Sequence[str],
    id_col: str = "property_id", top_k: int = 60,
) -> DataFrame:
    """Insights of every row of ``df``, strongest impact first.

    Impacts, their total, the order and the cut are all worked out on the row's own vector,
    so explaining every property costs one pass and no shuffle.
    """
    scored = model.transform(df)
    own = F.array(
        *[F.col(f"`{c}`").cast("double") for c in numerics],
        *[F.lit(None).cast("double") for _ in range(len(slots) - len(numerics))],
    )

    def constants(values: list, kind: str) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")

    zipped = F.arrays_zip(
        constants([s.name for s in slots], "string").alias("name"),
        constants([s.coef for s in slots], "double").alias("coef"),
        vector_to_array("features_scaled").alias("scaled"),
        constants([s.top_scaled for s in slots], "double").alias("top_scaled"),
        own.alias("own"),
        constants([s.top_value for s in slots], "double").alias("top_value"),
    )
    return ranked_effects(scored.select(F.col(id_col).alias("property_id"), zipped.alias("slots")), top_k)


def ranked_effects(rows: DataFrame, top_k: int = 60, keys: Sequence[str] = ("property_id",)) -> DataFrame:
    """Insights out of each row's ``slots``, strongest impact first; equal impacts by name.

    A slot is (name, coef, scaled, top_scaled, own, top_value). Impacts are compared at nine
    digits, so features that move alike keep their order whatever the order of summation was.
    """
    effects = F.transform(
        "slots",
        lambda s: F.struct(
            (-F.round(F.abs(s["coef"] * s["scaled"]), 9)).alias("order"),
            s["name"].alias("name"),
            s["own"].alias("my_value"),
            s["top_value"].alias("market_avg"),
            market_trend(s["coef"]).alias("market_trend"),
            (s["coef"] * s["scaled"]).alias("current_impact"),
            (s["coef"] * (s["top_scaled"] - s["scaled"])).alias("opportunity"),
        ),
    )
    total = F.aggregate("effects", F.lit(0.0), lambda t, e: t + F.abs(e["current_impact"]))
    return (
        rows.select(*keys, effects.alias("effects"))
        .withColumn("total", total)
        .select(
            *keys,
            F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")).alias("total"),
            F.posexplode(F.slice(F.array_sort("effects"), 1, top_k)).alias("position", "e"),
        )
        .select(
            *keys, (F.col("position") + 1).alias("position"), "e.name", "e.my_value", "e.market_avg",
            "e.market_trend", "e.current_impact", "e.opportunity",
            (F.abs("e.current_impact") / F.col("total") * 100).alias("importance_pct"),
        )
    )


def impact_feed(insights: DataFrame, top_n: int = 10) -> DataFrame:
    """Chart feed: the strongest effects per property with readable labels."""
    return _top(insights, "importance_pct", top_n).select(
        "property_id", "position", F.col("name").alias("feature"),
        tx.feature_label(F.col("name")).alias("feature_label"), "importance_pct",
    )


def gain_feed(insights: DataFrame, top_n: int = 10, min_gain: float = 0.01) -> DataFrame:
    """Chart feed: the largest estimated gains above ``min_gain`` per property."""
    return _top(insights.filter(F.col("opportunity") > min_gain), "opportunity", top_n).select(
        "property_id", "position", F.col("name").alias("feature"),
        tx.feature_label(F.col("name")).alias("feature_label"), "opportunity",
    )


def _top(insights: DataFrame, by: str, top_n: int) -> DataFrame:
    from pyspark.sql import Window

    window = Window.partitionBy("property_id").orderBy(F.desc(by), "name")
    return insights.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= top_n)


def insight_lines(insights: DataFrame, top_n: int = 10) -> DataFrame:
    """One readable line per leading insight, numbered per property."""
    top = _top(insights.filter(F.col("importance_pct") > 0), "importance_pct", top_n)
    name = F.replace(F.replace(F.col("name"), F.lit("__imp"), F.lit("")), F.lit("amen_"), F.lit(""))
    label = tx.title_case(F.replace(name, F.lit("_"), F.lit(" ")))
    mine = F.coalesce(F.col("my_value").cast("string"), F.lit("N/A"))
    average = F.coalesce(F.format_string("%.2f", F.col("market_avg")), F.lit("N/A"))
    average = F.when(F.col("market_avg").isNull(), F.lit("N/A")).otherwise(average)
    gain = F.when(
        F.col("opportunity") > 0.05, F.format_string(" | Opp: +%.2f", F.col("opportunity"))
    ).otherwise("")
    line = F.concat(
        F.format_string("%d. ", F.col("position")), label,
        F.format_string(" (%.0f%%) - You: ", F.col("importance_pct")), mine,
        F.lit(", Avg: "), average, F.format_string(", Impact: %+.2f", F.col("current_impact")), gain,
    )
    return top.select("property_id", "position", line.alias("line"))
