"""Source listings and reviews to documents of one shape, in four namespaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import (
    AIRBNB_HOTEL_TEXT,
    AIRBNB_PREFIX,
    BOOKING_HOTEL_TEXT,
    BOOKING_PREFIX,
    HOTEL_DEFAULTS,
    MISSING_TEXT,
    PROPERTY_DEFAULTS,
    REVIEW_TEXT,
    UNTITLED_PROPERTY,
)
from innsight.functions import ids
from innsight.functions.reviews import split_reviews

DOCUMENT_COLUMNS = [
    "namespace", "doc_id", "source", "hotel_id", "original_id", "title", "city", "country", "rating", "text",
]
MIN_REVIEW_CHARS = 10


def _first_rows(df: DataFrame, limit: int | None, order: str) -> DataFrame:
    return df if limit is None else df.orderBy(order).limit(limit)


def decimal_rating(rating: Column) -> Column:
    """A rating written with a decimal comma or point; anything else is 0."""
    return F.coalesce(F.replace(rating, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def _text(form: str, *fields: str) -> Column:
    """A document text: the form filled with the fields, missing ones by their stand-in."""
    filled = [F.coalesce(F.col(f).cast("string"), F.lit(MISSING_TEXT)) for f in fields]
    return F.format_string(form, *filled)


def booking_hotel_documents(hotels: DataFrame, city: str | None = None, limit: int | None = None) -> DataFrame:
    df = hotels.select(
        "hotel_id", "title", "description", "city", "country", "review_score",
        F.concat_ws(", ", "most_popular_facilities").alias("facilities"),
    ).fillna(HOTEL_DEFAULTS)
    if city:
        df = df.filter(F.col("city") == city)
    text = _text(BOOKING_HOTEL_TEXT, "title", "city", "country", "review_score", "facilities", "description")
    hotel_id = ids.prefixed(BOOKING_PREFIX, F.col("hotel_id"))
    return _first_rows(df, limit, "hotel_id").select(
        F.lit("booking_hotels").alias("namespace"), hotel_id.alias("doc_id"), F.lit("booking").alias("source"),
        hotel_id.alias("hotel_id"), F.col("hotel_id").cast("string").alias("original_id"), "title", "city",
        "country", F.coalesce(F.col("review_score").cast("double"), F.lit(0.0)).alias("rating"),
        text.alias("text"),
    )


def booking_review_documents(hotels: DataFrame, city: str | None = None, limit: int | None = None) -> DataFrame:
    """One document per review; null reviews are dropped after numbering, so numbers keep gaps."""
    df = hotels.filter(F.col("top_reviews").isNotNull())
    if city:
        df = df.filter(F.col("city") == city)
    df = (
        _first_rows(df, limit, "hotel_id")
        .select("hotel_id", "title", "city", "country", F.posexplode("top_reviews").alias("pos", "item"))
        .filter(F.col("item.review").isNotNull())
    )
    hotel_id = ids.prefixed(BOOKING_PREFIX, F.col("hotel_id"))
    text = _text(REVIEW_TEXT, "title", "city", "item.review")
    return df.select(
        F.lit("booking_reviews").alias("namespace"),
        F.concat(hotel_id, F.lit("_R"), F.col("pos").cast("string")).alias("doc_id"),
        F.lit("booking").alias("source"), hotel_id.alias("hotel_id"),
        F.col("hotel_id").cast("string").alias("original_id"), "title", "city", "country",
        F.lit(None).cast("double").alias("rating"), text.alias("text"),
    )


_AIRBNB_IDENTITY = ("name", "listing_name", "location", "country", "description")


def _airbnb_identified(listings: DataFrame) -> DataFrame:
    """Listings with ``original_id``: their id, or a stand-in from all that identifies them.

    It is taken before defaults are filled in, so hotels and reviews get the same.
    """
    known = F.nullif(F.col("property_id").cast("string"), F.lit(""))
    original = F.coalesce(known, ids.surrogate_id(*[F.col(c) for c in _AIRBNB_IDENTITY]))
    return listings.withColumn("original_id", original)


def _airbnb_title() -> Column:
    return F.coalesce(
        F.nullif(F.col("listing_name"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.lit(UNTITLED_PROPERTY)
    )


def airbnb_hotel_documents(listings: DataFrame, city: str | None = None, limit: int | None = None) -> DataFrame:
    df = _airbnb_identified(listings).fillna(PROPERTY_DEFAULTS)
    if city:
        df = df.filter(F.col("location").contains(city))
    rating = decimal_rating(F.col("ratings"))
    df = _first_rows(df, limit, "property_id").select(
        "*", _airbnb_title().alias("title"), rating.alias("rating")
    )
    hotel_id = ids.prefixed(AIRBNB_PREFIX, F.col("original_id"))
    text = _text(
        AIRBNB_HOTEL_TEXT, "title", "location", "country", "rating", "guests", "category", "price",
        "amenities", "description",
    )
    return df.select(
        F.lit("airbnb_hotels").alias("namespace"), hotel_id.alias("doc_id"), F.lit("airbnb").alias("source"),
        hotel_id.alias("hotel_id"), "original_id", "title", F.col("location").alias("city"), "country",
        "rating", text.alias("text"),
    )


def airbnb_review_documents(listings: DataFrame, city: str | None = None, limit: int | None = None) -> DataFrame:
    """One document per parsed review of at least ten characters; numbers keep gaps."""
    df = _airbnb_identified(listings).filter(F.col("reviews").isNotNull() & (F.col("reviews") != ""))
    if city:
        df = df.filter(F.col("location").contains(city))
    df = (
        _first_rows(df, limit, "property_id")
        .select(
            "original_id", _airbnb_title().alias("title"), "location", "country",
            F.posexplode(split_reviews(F.col("reviews"))).alias("pos", "review"),
        )
        .filter(F.length("review") >= MIN_REVIEW_CHARS)
    )
    hotel_id = ids.prefixed(AIRBNB_PREFIX, F.col("original_id"))
    text = _text(REVIEW_TEXT, "title", "location", "review")
    return df.select(
        F.lit("airbnb_reviews").alias("namespace"),
        F.concat(hotel_id, F.lit("_R"), F.col("pos").cast("string")).alias("doc_id"),
        F.lit("airbnb").alias("source"), hotel_id.alias("hotel_id"), "original_id", "title",
        F.coalesce("location", F.lit("")).alias("city"), F.coalesce("country", F.lit("")).alias("country"),
        F.lit(None).cast("double").alias("rating"), text.alias("text"),
    )


def corpus(*parts: DataFrame) -> DataFrame:
    """All document frames as one."""
    return reduce(DataFrame.unionByName, [p.select(*DOCUMENT_COLUMNS) for p in parts])


def namespace_summary(documents: DataFrame) -> DataFrame:
    return documents.groupBy("namespace").agg(
        F.count("*").alias("documents"), F.count_distinct("hotel_id").alias("hotels")
    )


def latest_versions(
    documents: DataFrame, keys: tuple[str, ...] = ("namespace", "doc_id"), version_col: str = "version"
) -> DataFrame:
    """One row per key: the one with the latest version, ties by text."""
    window = Window.partitionBy(*keys).orderBy(F.desc(version_col), "text")
    return documents.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")


def merge_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by namespace and id."""
    return latest_versions(current.unionByName(incoming, allowMissingColumns=True))


def clear_namespaces(documents: DataFrame, namespaces: list[str]) -> DataFrame:
    return documents.filter(~F.col("namespace").isin(namespaces))
