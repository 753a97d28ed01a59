"""Listing features for the rating regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.fixed_values import (
    AMENITY_MERGES,
    CANCELLATION_BUCKETS,
    CATEGORY_RATING_PATTERN,
    CATEGORY_RATINGS,
    FX_RATES,
    GLOBAL_AMENITIES,
)

AMENITIES_TYPE = "array<struct<group_name:string,items:array<struct<name:string,value:string>>>>"


def fx_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FX_RATES, "currency string, to_usd double")


def with_usd_price(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``price_usd``: a missing currency counts as USD, an unknown one gives null."""
    filled = listings.withColumn("currency", F.coalesce("currency", F.lit("USD")))
    return filled.join(rates, "currency", "left").withColumn("price_usd", F.col("price") * F.col("to_usd"))


def with_price_per_guest(listings: DataFrame) -> DataFrame:
    """Add ``price_per_guest``; missing and non-positive guest counts become one."""
    guests = F.col("guests").cast("double")
    return listings.withColumn(
        "guests", F.when(guests.isNull() | (guests <= 0), F.lit(1.0)).otherwise(guests)
    ).withColumn("price_per_guest", F.col("price_usd") / F.col("guests"))


def cancellation_bucket(policy: Column) -> Column:
    """First bucket whose phrase the policy text contains, else ``unknown``."""
    text = F.lower(policy.cast("string"))
    phrases = iter(CANCELLATION_BUCKETS)
    phrase, bucket = next(phrases)
    chosen = F.when(text.contains(phrase), bucket)
    for phrase, bucket in phrases:
        chosen = chosen.when(text.contains(phrase), bucket)
    return chosen.otherwise("unknown")


def category_rating(ratings: Column, name: str) -> Column:
    """Rating of one category out of the JSON text; null when it is not there."""
    pattern = CATEGORY_RATING_PATTERN.format(name=name)
    return F.regexp_extract(ratings.cast("string"), pattern, 1).try_cast("double")


def with_doubles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cast the listed columns to double where they exist; unreadable values become null."""
    for name in names:
        if name in df.columns:
            column = F.col(name)
            if df.schema[name].dataType.simpleString() == "string":
                df = df.withColumn(name, column.try_cast("double"))
            else:
                df = df.withColumn(name, column.cast("double"))
    return df


def listing_features(listings: DataFrame, rates: DataFrame, label_col: str = "ratings") -> DataFrame:
    """Price, cancellation and category-rating features, and the label as double."""
    df = with_price_per_guest(with_usd_price(listings, rates))
    df = df.withColumn("cancellation_bucket", cancellation_bucket(F.col("cancellation_policy")))
    for column, name in CATEGORY_RATINGS:
        df = df.withColumn(column, category_rating(F.col("category_rating"), name))
    return with_doubles(df, ["price_per_guest", "is_super_host", label_col])


def merged_amenity(name: Column) -> Column:
    """One name for the variants of an amenity."""
    merged = name
    for part, target in reversed(AMENITY_MERGES):
        merged = F.when(name.contains(part), target).otherwise(merged)
    return merged


def amenity_items(
    listings: DataFrame, id_col: str = "property_id", amenities_col: str = "amenities"
) -> DataFrame:
    """One row per named amenity of the JSON text: ``(property_id, name)``."""
    groups = F.from_json(F.col(amenities_col).cast("string"), AMENITIES_TYPE)
    items = (
        listings.select(F.col(id_col).alias("property_id"), F.explode_outer(groups).alias("group"))
        .select("property_id", F.explode_outer("group.items").alias("item"))
        .select("property_id", F.lower("item.name").alias("name"))
        .filter(F.col("name").isNotNull())
    )
    return items.withColumn("name", merged_amenity(F.col("name")))


def amenity_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("name").agg(F.count("*").alias("count"))


def top_amenities(items: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent amenities, ties by name."""
    return amenity_counts(items).orderBy(F.desc("count"), "name").limit(k)


def chosen_amenities(
    items: DataFrame, k: int = 20, always: Sequence[str] = tuple(GLOBAL_AMENITIES)
) -> DataFrame:
    """Frequent amenities together with those always included."""
    spark = items.sparkSession
    fixed = spark.createDataFrame([(a.lower(),) for a in always], "name string")
    return top_amenities(items, k).select("name").union(fixed).distinct()


def amenity_columns(names: Sequence[str]) -> dict[str, str]:
    """Column name per amenity; clashes after cleaning get a number."""
    columns: dict[str, str] = {}
    for name in sorted(names):
        base = "amen_" + name
        for mark in (" ", "-", ".", "`", '"', "'"):
            base = base.replace(mark, "_")
        column, n = base, 2
        while column in columns.values():
            column, n = f"{base}_{n}", n + 1
        columns[name] = column
    return columns


def amenity_list(amenities: Column) -> Column:
    """Amenity names of one listing's JSON text, variants merged, repeats kept."""
    groups = F.filter(F.from_json(amenities.cast("string"), AMENITIES_TYPE), lambda g: g["items"].isNotNull())
    named = F.transform(groups, lambda g: F.filter(g["items"], lambda i: i["name"].isNotNull()))
    return F.transform(F.flatten(named), lambda i: merged_amenity(F.lower(i["name"])))


def amenity_names(amenities: Column) -> Column:
    """Distinct amenity names of one listing's JSON text, variants merged."""
    return F.array_distinct(amenity_list(amenities))


def with_amenities(
    listings: DataFrame, k: int = 20, always: Sequence[str] = tuple(GLOBAL_AMENITIES),
    id_col: str = "property_id", amenities_col: str = "amenities",
) -> tuple[DataFrame, list[str]]:
    """Listings with a 0/1 column per chosen amenity, and the names of these columns.

    Which amenities are frequent takes one aggregation; the flags are then read off each
    listing's own text, without grouping or joining anything back. Only the chosen names
    come to the driver: they become column names.
    """
    items = amenity_items(listings, id_col, amenities_col)
    names = chosen_amenities(items, k, always).collect()  # at most k + len(always)
    columns = amenity_columns([r["name"] for r in names])
    own = F.coalesce(amenity_names(F.col(amenities_col)), F.array().cast("array<string>"))
    flags = {
        column: F.array_contains("_amenities", name).cast("double") for name, column in columns.items()
    }
    return listings.withColumn("_amenities", own).withColumns(flags).drop("_amenities"), list(flags)


def long_features(df: DataFrame, features: Sequence[str], id_col: str = "property_id") -> DataFrame:
    """Unpivot feature columns to ``(property_id, feature, value)``."""
    casted = df.select(F.col(id_col).alias("property_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    return casted.unpivot("property_id", list(features), "feature", "value")
