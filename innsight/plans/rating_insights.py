"""The rating regression: which features drive a rating, and where the gains are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import CATEGORY_RATINGS, GLOBAL_AMENITIES
from innsight.operators import cell_models as cm
from innsight.operators import explain as ex
from innsight.operators import features as ft
from innsight.operators import neighbours as nb

NUMERICS = ["price_per_guest", *[column for column, _ in CATEGORY_RATINGS], "is_super_host"]
CATEGORICALS = ["cancellation_bucket"]


@dataclass
class RatingModel:
    model: PipelineModel
    slots: list[ex.Slot]
    numerics: list[str]


def feature_frame(
    listings: DataFrame, rates: DataFrame, k: int = 20, always: Sequence[str] = tuple(GLOBAL_AMENITIES)
) -> tuple[DataFrame, list[str], list[str]]:
    """Listings with all features: the frame, its numeric and its categorical feature names."""
    base = ft.listing_features(listings, rates)
    df, amenities = ft.with_amenities(base, k, always)
    numerics = [c for c in NUMERICS if c in df.columns] + amenities
    return df, numerics, [c for c in CATEGORICALS if c in df.columns]


def fit_ratings(
    df: DataFrame, numerics: Sequence[str], categoricals: Sequence[str], label_col: str = "ratings",
    leave_out: str | None = None,
) -> RatingModel:
    """Fit the model and the benchmark of the top fifth on the labelled rows.

    The stages read their rows several times, so the columns they need are kept for the
    time of the fit. Numeric columns without a single value cannot be imputed and are left
    out.
    """
    rows = ex.training_rows(df, label_col, leave_out)
    train = rows.select(label_col, *[F.col(f"`{c}`") for c in [*numerics, *categoricals]]).persist()
    try:
        filled = train.agg(*[F.count(f"`{c}`").alias(c) for c in numerics]).first()
        numerics = [c for c in numerics if filled[c] > 0]
        model = ex.rating_pipeline(numerics, categoricals, label_col).fit(train)
        top = ex.benchmark(train, label_col, numerics, categoricals)
        return RatingModel(model, ex.vector_slots(model, top, numerics), list(numerics))
    finally:
        train.unpersist()


def explain_all(df: DataFrame, fitted: RatingModel, top_k: int = 60) -> DataFrame:
    """Insights of every property in the frame."""
    return ex.explain(df, fitted.model, fitted.slots, fitted.numerics, top_k=top_k)


def explain_property(listings: DataFrame, property_id: str, rates: DataFrame, top_k: int = 60) -> DataFrame:
    """Insights of one property from a model of its neighbourhood, fitted without it."""
    spark = listings.sparkSession
    nb.require_targets(listings, [property_id])
    target = spark.createDataFrame([(str(property_id),)], "property_id string")
    members = nb.neighbourhood(listings, target).select("property_id")
    area = listings.withColumn("property_id", F.col("property_id").cast("string")).join(
        members, "property_id", "left_semi"
    )
    df, numerics, categoricals = feature_frame(area, rates)
    fitted = fit_ratings(df, numerics, categoricals, leave_out=str(property_id))
    return explain_all(df.filter(F.col("property_id") == str(property_id)), fitted, top_k)


def fit_cells(
    listings: DataFrame, rates: DataFrame, k: int = 20, always: Sequence[str] = tuple(GLOBAL_AMENITIES)
) -> cm.CellModels:
    """One rating model per area that listings are compared in, all areas in one job."""
    base = ft.listing_features(listings, rates)
    return cm.fit_cells(base, [c for c in NUMERICS if c in base.columns], CATEGORICALS[0], k, always)


def fit_everywhere(
    listings: DataFrame, rates: DataFrame, k: int = 20, always: Sequence[str] = tuple(GLOBAL_AMENITIES)
) -> cm.CellModels:
    """The same with all listings as one area (resolution 0, cell ``all``)."""
    cells = [c for c in listings.columns if c.startswith("h3_")] + ["geo_bucket_res", nb.geo_column(listings)]
    one = listings.drop(*cells).withColumns(
        {"h3_0": F.lit("all"), "geo_bucket_res": F.lit(0), "geo_bucket": F.lit("all")}
    )
    return fit_cells(one, rates, k, always)


def explain_cells(listings: DataFrame, rates: DataFrame, top_k: int = 60) -> DataFrame:
    """Insights of every property by the model of its area."""
    return cm.explain_members(fit_cells(listings, rates), top_k)


def explain_properties(listings: DataFrame, rates: DataFrame, top_k: int = 60) -> DataFrame:
    """Insights of every property by the model of its area, fitted without that property."""
    return cm.explain_left_out(fit_cells(listings, rates), top_k)


def insight_payloads(insights: DataFrame) -> DataFrame:
    """One JSON list of insights per property, strongest first."""
    item = F.struct(
        "position", "name", "my_value", "market_avg", "market_trend", "current_impact", "opportunity",
        "importance_pct",
    )
    # bounded: the leading insights of one property
    return insights.groupBy("property_id").agg(
        F.to_json(F.array_sort(F.collect_list(item))).alias("insights_json")
    )


def combined_report(comparison_payloads: DataFrame, insights: DataFrame, hotels: DataFrame) -> DataFrame:
    """Both analyses per requested hotel; other sources than airbnb get an error text.

    ``hotels`` holds prefixed ``hotel_id`` values.
    """
    from innsight.functions import ids

    asked = hotels.select(
        "hotel_id", ids.raw_id(F.col("hotel_id")).alias("property_id"),
        ids.source_of(F.col("hotel_id")).alias("source"),
    )
    own = ids.is_airbnb(F.col("hotel_id"))
    supported = asked.filter(own).join(comparison_payloads, "property_id", "left").join(
        insight_payloads(insights), "property_id", "left"
    ).withColumn("error", F.lit(None).cast("string"))
    refused = asked.filter(~own).select(
        "*", F.lit(None).cast("string").alias("payload_json"), F.lit(None).cast("string").alias("insights_json"),
        F.lit("Only Airbnb properties (ABB_ prefix) are supported.").alias("error"),
    )
    return supported.unionByName(refused).select(
        "hotel_id", "property_id", "source", "payload_json", "insights_json", "error"
    )
