"""Parsing of review columns that hold several reviews in one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.functions.text import strip

_NUMBERED = ("1.", "2.", "3.", "4.")
_DELIMITERS = (("\n\n", "\n\n"), ("|", r"\|"), ("---", "---"))
_ITEM_KEYS = ("review", "text", "comment")


def json_reviews(reviews: Column, max_reviews: int | None = None) -> Column:
    """A JSON array of strings as ``array<string>``; anything else gives an empty array."""
    parsed = F.coalesce(F.from_json(reviews, "array<string>"), F.array().cast("array<string>"))
    return parsed if max_reviews is None else F.slice(parsed, 1, max_reviews)


def _clean_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def _review_of_item(item: Column) -> Column:
    """Text of one JSON list item: a string as it is, an object by its first filled key."""
    kind = F.schema_of_variant(item)
    filled = [
        F.nullif(F.try_variant_get(item, f"$.{key}", "string"), F.lit("")) for key in _ITEM_KEYS
    ]
    from_object = F.coalesce(*filled, F.to_json(item))
    return F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).when(
        kind.startswith("OBJECT"), from_object
    )


def split_reviews(reviews: Column) -> Column:
    """Individual reviews of a free-form string.

    Tried in this order: JSON list, JSON string, numbered list, first delimiter present,
    and the whole string when it is longer than 20 characters.
    """
    document = F.try_parse_json(reviews)
    kind = F.schema_of_variant(document)
    items = F.transform(F.try_variant_get(document, "$", "array<variant>"), _review_of_item)

    numbered = F.lit(False)
    for mark in _NUMBERED:
        numbered = numbered | reviews.contains(mark)

    ladder = (
        F.when(reviews.isNull() | (strip(reviews) == ""), F.array().cast("array<string>"))
        .when(kind.startswith("ARRAY"), F.filter(items, lambda item: item.isNotNull()))
        .when(kind == "STRING", F.array(F.try_variant_get(document, "$", "string")))
        .when(numbered, _clean_parts(F.split(reviews, r"\d+\.\s*")))
    )
    for mark, pattern in _DELIMITERS:
        ladder = ladder.when(reviews.contains(mark), _clean_parts(F.split(reviews, pattern)))
    return ladder.when(F.length(reviews) > 20, F.array(reviews)).otherwise(
        F.array().cast("array<string>")
    )
