"""Text cleaning and matching on string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"
_SENTENCE_MARK = "\u0001"


def strip(text: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalise_review(text: Column) -> Column:
    """Lower-case and collapse runs of white space to one blank.

    Single blanks stay as they are: only what changes is matched, not every gap between words.
    """
    return F.regexp_replace(F.lower(text), r"\s{2,}|[\t\n\x0B\f\r]", " ")


def english_like(text: Column, max_non_ascii: float = 0.20) -> Column:
    """True for text with a Latin letter and at most the given share of non-ASCII characters.

    Where any share will do, characters are not counted.
    """
    if max_non_ascii >= 1:
        return text.rlike("[A-Za-z]")
    non_ascii = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))  # runs, not characters one by one
    share = non_ascii / F.greatest(F.length(text), F.lit(1))
    return text.rlike("[A-Za-z]") & (share <= F.lit(float(max_non_ascii)))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; the marks stay in place."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1" + _SENTENCE_MARK)
    return F.split(marked, _SENTENCE_MARK)


def cap(text: Column, limit: int, suffix: str = "") -> Column:
    """Cut text longer than ``limit`` characters and mark the cut with ``suffix``."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(suffix))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def cap_with_count(text: Column, limit: int) -> Column:
    """Cut text like :func:`cap`, the mark naming how many characters were left out."""
    left_out = (F.length(text) - F.lit(limit)).cast("string")
    mark = F.concat(F.lit("\n... [truncated "), left_out, F.lit(" chars]"))
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), mark)
    ).otherwise(text)


def word_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when one of the words is a substring of the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def count_found(text: Column, words: Sequence[str]) -> Column:
    """How many of the words are substrings of the text."""
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total


def words_found(text: Column, words: Sequence[str]) -> Column:
    """The words, in list order, that are substrings of the text."""
    return F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words]))


def word_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def title_case(text: Column) -> Column:
    """Capitalise every run of letters, also after digits and punctuation."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def feature_label(name: Column) -> Column:
    """Readable feature name: no ``amen_`` prefix, no ``_imp`` suffix, blanks, title case."""
    bare = F.regexp_replace(F.regexp_replace(name, "^amen_", ""), "_imp$", "")
    spaced = F.regexp_replace(F.replace(bare, F.lit("_"), F.lit(" ")), r"\s+", " ")
    return title_case(strip(spaced))


def fuzzy_contains(needle: Column, haystack: Column, haystack_words: Column, threshold: float) -> Column:
    """Substring match, else enough of the needle's words are among ``haystack_words``."""
    words = word_tokens(needle)
    shared = F.size(F.array_intersect(words, haystack_words)) / F.size(words)
    overlaps = F.when(F.size(words) > 0, shared >= F.lit(float(threshold))).otherwise(F.lit(False))
    usable = (F.length(needle) > 0) & (F.length(haystack) > 0)
    return F.coalesce(usable & (F.contains(haystack, needle) | overlaps), F.lit(False))
