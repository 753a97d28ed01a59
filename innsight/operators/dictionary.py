"""Dictionaries of any size looked up in texts: one automaton, walked once per text.

All terms become one multi-pattern automaton (trie with failure links), so a text is read once
however many terms there are, and overlapping terms are all found. Automata travel to the tasks
as broadcasts of bounded size: a dictionary of more than ``TERMS`` terms is cut by a hash into
several of at most about that many, each with its own pass over the texts.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions import text as tx

#: Terms per automaton; a term costs some hundred bytes.
TERMS = 500_000
#: Bytes of texts whose terms a task holds at once.
SLICE_BYTES = 1 << 20

FOUND = "array<struct<term: string, first: int, n: int>>"
_FOUND = pa.list_(pa.struct([("term", pa.string()), ("first", pa.int32()), ("n", pa.int32())]))
_LOADED: dict[str, ahocorasick.Automaton] = {}


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    """The automaton of some terms; empty ones are left out."""
    built = ahocorasick.Automaton()
    for term in terms:
        if term:
            built.add_word(term, term)
    if len(built):
        built.make_automaton()
    return built


def occurrences(built: ahocorasick.Automaton, text: str | None) -> list[dict]:
    """Every term of a text with its first place and how often it occurs, overlaps included."""
    found: dict[str, list[int]] = {}
    if text and len(built):
        for end, term in built.iter(text):
            seen = found.get(term)
            if seen is None:
                found[term] = [end - len(term) + 1, 1]
            else:
                seen[1] += 1
    return [{"term": term, "first": first, "n": n} for term, (first, n) in found.items()]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have up to ``most`` bytes, the last text aside."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes, dtype=np.int64) - sizes) // most, prepend=-1)).tolist()
    for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, stop - start)


def _matches(texts: DataFrame, terms: list[str]) -> DataFrame:
    """The texts with ``_found``, from one broadcast automaton."""
    shared = texts.sparkSession.sparkContext.broadcast(pickle.dumps(automaton(terms)))
    schema, name = texts.schema, uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOADED:  # one per worker process, the dictionary in use
            _LOADED.clear()
            _LOADED[name] = pickle.loads(shared.value)
        for batch in (part for whole in batches for part in slices(whole, "_text")):
            text = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            found = pa.array([occurrences(_LOADED[name], t) for t in text], _FOUND)
            kept = [i for i, column in enumerate(batch.schema.names) if column != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], found], names=[*[batch.schema.names[i] for i in kept], "_found"])

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "_text"], f"_found {FOUND}"])
    return texts.mapInArrow(work, kinds)


def find_terms(
    texts: DataFrame, terms: DataFrame, keep: Sequence[str], text_col: str = "text", term_col: str = "term", size: int = TERMS
) -> DataFrame:
    """``(*keep, term, first, n)``: the terms that each text contains, whatever the case.

    ``first`` is the place of the first occurrence (from 0), ``n`` the number of occurrences,
    overlapping ones included. Terms count once however often they are listed; null and empty
    ones are in no text. Each row of ``texts`` stands for itself.
    """
    listed = terms.select(F.lower(F.col(term_col)).alias("term")).where("term != ''").distinct()
    count = listed.count()
    groups = max(1, math.ceil(count / size))
    rows = texts.select(*keep, F.lower(F.col(text_col)).alias("_text"))
    out = None
    for g in range(groups):
        part = listed if groups == 1 else listed.where(F.pmod(F.xxhash64("term"), F.lit(groups)) == g)
        words = sorted(r["term"] for r in part.collect())  # at most about ``size``
        found = _matches(rows, words).select(*keep, F.inline("_found"))
        out = found if out is None else out.unionByName(found)
    return out


def topics_by_terms(
    sentences: DataFrame, terms: DataFrame, *, top_n: int | None = 2, max_non_ascii: float = 0.20,
    keep: Sequence[str] = ("property_id", "sentence_id"), text_col: str = "sentence_text",
) -> DataFrame:
    """Best topics per sentence, the similarity being the share of a topic's terms that it holds.

    ``terms`` holds ``(topic, term)`` for any number of topics. ``keep`` tells sentences apart.
    """
    listed = terms.select("topic", F.lower("term").alias("term")).where("term != ''")
    sizes = listed.groupBy("topic").agg(F.count("*").alias("size"))
    english = sentences.where(tx.english_like(F.col(text_col), max_non_ascii))
    found = find_terms(english, listed, keep, text_col)
    shares = (
        found.join(listed, "term").groupBy(*keep, "topic").agg(F.count("*").alias("hits"))
        .join(sizes, "topic").withColumn("topic_similarity", F.col("hits") / F.col("size"))
    )
    if top_n is not None:
        window = Window.partitionBy(*keep).orderBy(F.desc("topic_similarity"), "topic")
        shares = shares.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= top_n)
    return shares.select(*keep, "topic", "topic_similarity")


def entities_by_terms(
    messages: DataFrame, terms: DataFrame, keep: Sequence[str] = ("conv_id", "turn"), text_col: str = "text"
) -> DataFrame:
    """``(*keep, kind, entity, first)``: the entities that messages name, once per message.

    ``terms`` holds ``(kind, term, entity)``: what to look for and how it is shown.
    """
    found = find_terms(messages, terms, keep, text_col)
    known = terms.select("kind", F.lower("term").alias("term"), "entity")
    return found.join(known, "term").groupBy(*keep, "kind", "entity").agg(F.min("first").alias("first"))


def mentions_by_terms(
    reviews: DataFrame, terms: DataFrame, queries: DataFrame, keep: Sequence[str], query_col: str = "query", text_col: str = "text"
) -> DataFrame:
    """``(query, *keep, hits)``: the texts that hold one of a query's terms, with the number of terms.

    ``terms`` holds ``(query, term)``; texts without any are left out. ``queries`` names the
    queries asked about.
    """
    asked = terms.join(queries.select(query_col).distinct(), query_col, "left_semi").select(query_col, F.lower("term").alias("term")).distinct()
    found = find_terms(reviews, asked, keep, text_col)
    return found.join(asked, "term").groupBy(query_col, *keep).agg(F.count("*").alias("hits"))

