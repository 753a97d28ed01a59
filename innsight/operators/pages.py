"""Extraction from stored map pages (HTML text and URL columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import MAP_COORDINATES_PATTERN, PAGE_CLASSES
from innsight.functions.text import strip

MIN_REVIEW_CHARS = 10


def _opening(css_class: str) -> str:
    """Pattern of an opening tag with a class; its first group is the element's name."""
    return rf'<([A-Za-z][A-Za-z0-9]*)\b[^>]*\bclass="[^"]*\b{css_class}\b[^"]*"[^>]*>'


def element_inside(name: Column, rest: Column) -> Column:
    """What an element holds, given its name and all that follows its opening tag.

    Tags of the same name are counted up and down, so an element ends at its own closing tag
    however often its name is nested; one that is left open reaches to the end. Tags closed in
    themselves do not count. The text is cut before the tags of that name and folded once; all
    pieces but the first start with such a tag, so that only the first is matched with its name.
    """
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)")))

    def step(piece: Column, n: Column) -> Column:
        tag = (n > 0) | F.regexp_like(piece, F.concat(F.lit("(?i)^</?"), name, F.lit(r"\b")))
        closing, alone = F.startswith(piece, F.lit("</")), F.regexp_like(piece, F.lit("^<[^>]*/>"))
        return F.when(~F.startswith(piece, F.lit("<")), 0).when(~tag, 0).when(closing, -1).when(alone, 0).otherwise(1)

    def seen(state: Column, piece: Column) -> Column:
        depth = state["depth"] + step(piece, state["n"])
        return F.when(state["open"], F.struct(
            depth.alias("depth"), (depth >= 0).alias("open"), (state["n"] + F.when(depth >= 0, 1).otherwise(0)).alias("n")
        )).otherwise(state)

    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("open"), F.lit(0).alias("n"))
    held = F.aggregate(pieces, start, seen, lambda state: state["n"])
    return F.when(name != "", F.array_join(F.slice(pieces, 1, held), "")).otherwise("")


def _first_element(html: Column, css_class: str) -> Column:
    """What the first element with a class holds; empty without one."""
    pattern = "(?s)" + _opening(css_class) + "(.*)$"
    return element_inside(F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2))


def plain_text(html: Column) -> Column:
    """Element text without tags, the common entities resolved."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(text)


def _first_text(html: Column, css_class: str) -> Column:
    return plain_text(_first_element(html, css_class))


def page_rating(html: Column) -> Column:
    """Average rating, written with a decimal point or comma."""
    text = _first_text(html, PAGE_CLASSES["rating"])
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def page_review_count(html: Column) -> Column:
    """First positive number among the count elements, thousands marks removed; 0 without one."""
    mark = _opening(PAGE_CLASSES["review_count"])
    parts = F.split(html, f"(?={mark})")
    # a part reaches to the next mark, an element may reach further
    onwards = F.transform(parts, lambda p, i: F.when(F.regexp_like(p, F.lit("^" + mark)), F.array_join(F.slice(parts, i + 1, F.size(parts)), "")))
    texts = F.transform(F.filter(onwards, lambda t: t.isNotNull()), lambda t: _first_element(t, PAGE_CLASSES["review_count"]))
    numbers = F.transform(
        texts,
        lambda t: F.replace(
            F.regexp_extract(F.replace(plain_text(t), F.lit("."), F.lit("")), r"([\d,]+)", 1), F.lit(","), F.lit("")
        ).try_cast("long"),
    )
    return F.coalesce(F.get(F.filter(numbers, lambda n: n > 0), F.lit(0)), F.lit(0).cast("long"))


def page_coordinates(url: Column) -> tuple[Column, Column]:
    lat = F.regexp_extract(url, MAP_COORDINATES_PATTERN, 1).try_cast("double")
    lng = F.regexp_extract(url, MAP_COORDINATES_PATTERN, 2).try_cast("double")
    return lat, lng


def businesses(pages: DataFrame) -> DataFrame:
    """One row per page: rating, review count and coordinates."""
    lat, lng = page_coordinates(F.col("url"))
    html = F.col("html")
    return pages.select(
        "page_id", page_rating(html).alias("rating"), page_review_count(html).alias("review_count"),
        lat.alias("lat"), lng.alias("lng"),
    )


def page_reviews(pages: DataFrame, max_reviews: int | None = None) -> DataFrame:
    """One row per review block with more than ten characters of text.

    ``(page_id, pos, review_text, rating, review_date, reviewer_name)``; ``max_reviews``
    looks at the first blocks of a page only.
    """
    mark = PAGE_CLASSES["review_block"]
    # a block reaches from its own mark to the next one
    parts = F.split(F.col("html"), rf'<div[^>]*class="[^"]*\b{mark}\b[^"]*"[^>]*>')
    blocks = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    if max_reviews is not None:
        blocks = F.slice(blocks, 1, max_reviews)
    block = F.col("block")
    stars = F.regexp_extract(F.regexp_extract(block, r'aria-label="([^"]*star[^"]*)"', 1), r"(\d)", 1)
    found = F.struct(
        _first_text(block, PAGE_CLASSES["review_text"]).alias("review_text"),
        stars.try_cast("int").alias("rating"),
        _first_text(block, PAGE_CLASSES["review_date"]).alias("review_date"),
        _first_text(block, PAGE_CLASSES["reviewer_name"]).alias("reviewer_name"),
    )
    # outer generators: Spark copies what an inner one or a plain column holds into the filter below it
    return (
        pages.select("page_id", F.posexplode_outer(blocks).alias("pos", "block"))
        .where(F.col("pos").isNotNull())
        .select("page_id", "pos", found.alias("found"))
        .select("page_id", "pos", F.inline_outer(F.array("found")))
        .filter(F.length("review_text") > MIN_REVIEW_CHARS)
    )
