"""Licence scan: a positional index of licence notices, looked up by each text's rarest words.

The index holds the words of a few public notices with their positions. Document frequencies of
these words, counted over all texts, order each notice's words from rare to common. A text looks
up the rarest of them that it holds itself; every place of such a word, minus its place in the
notice, is where the notice would have to begin. Beginnings on which enough of the rare words
agree are verified: the notice's mandatory phrases have to stand there. All of it is column
expressions on the text's own row; the only shuffle sums up the document frequencies.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.work import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that mark a licence wherever they stand, with its label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, a sentence of the public notice, and the phrases that it must hold.
NOTICES = (
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
     ("affero general public license",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the License", ("except in compliance with the license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted", ("with or without fee",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ("lesser general public license",)),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files", ("permission is hereby granted", "free of charge")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
     ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.",
     ("unencumbered software", "public domain")),
)


@dataclass(frozen=True)
class Lookup:
    """How many of a text's rarest notice words are looked up, and how many must agree on a beginning.

    Mandatory phrases may stand up to ``slack`` words outside the notice's own stretch.
    """

    rare: int = 4
    agree: int = 3
    slack: int = 2


def split_words(text: str) -> list[str]:
    """The words of an ASCII notice, as the columns cut them."""
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


VOCABULARY = sorted({w for _, text, _ in NOTICES for w in split_words(text)} | {w for p, _ in PHRASES for w in split_words(p)})


def words_of(text: Column) -> Column:
    """Words of ASCII digits, lower-cased ASCII letters and any other characters; none for null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _phrases() -> Column:
    return F.array(*[F.struct(_strings(split_words(p)).alias("words"), F.lit(label).alias("label")) for p, label in PHRASES])


def _notices(frequency: dict[str, int]) -> Column:
    """The index: per notice its words by position, and its distinct words from rare to common."""
    entries = []
    for label, text, phrases in NOTICES:
        words = split_words(text)
        ranked = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        needed = sorted({w for p in phrases for w in split_words(p)})
        entries.append(
            F.struct(
                F.lit(label).alias("label"), _strings(words).alias("words"), _strings(ranked).alias("ranked"),
                _strings(needed).alias("needed"), _strings([f" {p} " for p in phrases]).alias("phrases"),
            )
        )
    return F.array(*entries)


def _all_in(needed: Column, present: Column) -> Column:
    return F.size(F.array_except(needed, present)) == 0


def _beginnings(notice: Column, chosen: Column, places: Column, lookup: Lookup) -> Column:
    """Where the notice would begin, if ``agree`` of the chosen words agree: each beginning once."""
    numbered = F.transform(notice.words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))

    def shifts(word: Column) -> Column:
        own = F.filter(places, lambda p: p.word == word)
        there = F.filter(numbered, lambda x: x.word == word)
        return F.array_distinct(F.flatten(F.transform(own, lambda p: F.transform(there, lambda x: p["at"] - x["at"]))))

    votes = F.sort_array(F.flatten(F.transform(chosen, shifts)))

    def agreed(values: Column) -> Column:
        return F.filter(
            values,
            lambda s, i: (F.coalesce(F.get(values, i + (lookup.agree - 1)), s - 1) == s)
            & (F.coalesce(F.get(values, i - 1), s - 1) != s),
        )

    # bound once by a one-element transform, so the votes are not worked out per element
    return F.flatten(F.transform(F.array(votes), agreed))


def _found(words: Column, present: Column, places: Column, active: Column, lookup: Lookup) -> Column:
    """Verified notices: label, first word, length and the share of words in place."""

    def verified(notice: Column) -> Column:
        chosen = F.slice(F.array_intersect(notice.ranked, present), 1, lookup.rare)

        def judged(at: Column) -> Column:
            first = F.greatest(at - lookup.slack, F.lit(0))
            last = at + F.size(notice.words) + lookup.slack
            region = F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, F.greatest(last - first, F.lit(0))), " "), F.lit(" "))
            in_place = F.size(F.filter(notice.words, lambda w, i: F.coalesce(F.get(words, at + i) == w, F.lit(False))))
            return F.struct(
                notice.label.alias("label"), at.cast("long").alias("first_word"),
                F.size(notice.words).cast("long").alias("length"),
                (in_place.cast("double") / F.size(notice.words)).alias("share"),
                F.forall(F.transform(F.array(region), lambda r: F.forall(notice.phrases, lambda p: r.contains(p))), lambda x: x).alias("holds"),
            )

        return F.filter(F.transform(_beginnings(notice, chosen, places, lookup), judged), lambda x: x.holds)

    return F.flatten(F.transform(active, verified))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lookup: Lookup = Lookup()) -> DataFrame:
    """(doc_id, n_words, places, notices, labels, base_labels, score) of every text.

    ``places`` are the phrases found (label, first word), by first word; ``notices`` the verified
    notices (label, first_word, length, share), ``share`` being the share of the notice's words
    that stand in place. ``base_labels`` are the labels of the phrases, ``labels`` those of
    phrases and notices, both distinct and sorted. ``score`` is the greatest share, at least
    one half where a phrase stands, and 0 without any label.

    Words are counted over all texts before the first look-up. Null and empty texts have no
    words, no labels and score 0. Texts of any length are read whole. Ties between equally
    frequent words go to the lesser word. Repeated rows count once each and are judged alike;
    null ids are kept. An empty table gives an empty result. Only the two named columns are
    read, so others cannot clash.

    A text is split once: what the second step needs (its notice words, and all words of texts
    that hold the words of some phrase) is written to the shared folder. The driver gets one
    number per word of the index, whatever the size of the corpus. Every text is one row, so no
    group of texts, however large, meets in a task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("present", F.array_intersect("words", _strings(VOCABULARY)))
    needs = F.array(
        *[_strings(sorted({w for p in phrases for w in split_words(p)})) for _, _, phrases in NOTICES],
        *[_strings(split_words(p)) for p, _ in PHRASES],
    )
    near = F.exists(needs, lambda needed: _all_in(needed, F.col("present")))
    kept = stored(
        rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", F.when(near, F.col("words")).alias("words")),
        "licence-words",
    )
    counted = kept.select(F.explode("present").alias("word")).groupBy("word").count().collect()
    notices = _notices({r["word"]: r["count"] for r in counted})

    active = F.filter(notices, lambda n: _all_in(n.needed, F.col("present")))
    near_rows = kept.where("words is not null").withColumn("active", active)
    looked_up = F.array_union(
        F.flatten(F.transform("active", lambda n: F.slice(F.array_intersect(n.ranked, F.col("present")), 1, lookup.rare))),
        _strings(sorted({split_words(p)[0] for p, _ in PHRASES})),
    )
    near_rows = near_rows.withColumn("looked_up", looked_up).withColumn(
        "occurring",
        F.filter(
            F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
            lambda p: F.array_contains(F.col("looked_up"), p.word),
        ),
    )
    phrase_places = F.flatten(
        F.transform(
            _phrases(),
            lambda p: F.transform(
                F.filter(
                    "occurring",
                    lambda o: (o.word == F.get(p.words, F.lit(0))) & (F.slice(F.col("words"), o["at"] + 1, F.size(p.words)) == p.words),
                ),
                lambda o: F.struct(o["at"].cast("long").alias("first_word"), p.label.alias("label")),
            ),
        )
    )
    judged = near_rows.select(
        "doc_id", "n_words", F.sort_array(phrase_places).alias("places"),
        _found(F.col("words"), F.col("present"), F.col("occurring"), F.col("active"), lookup).alias("found"),
    )
    place, notice = "array<struct<first_word: bigint, label: string>>", "array<struct<label: string, first_word: bigint, length: bigint, share: double>>"
    out = judged.select(
        "doc_id", "n_words", F.col("places").cast(place).alias("places"),
        F.sort_array(F.transform("found", lambda x: F.struct(x.label.alias("label"), x.first_word.alias("first_word"), x.length.alias("length"), x.share.alias("share")))).cast(notice).alias("notices"),
    ).unionByName(
        kept.where("words is null").select(
            "doc_id", "n_words", F.array().cast(place).alias("places"), F.array().cast(notice).alias("notices")
        )
    )
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("notices.label"))))
    score = F.greatest(
        F.coalesce(F.array_max("notices.share"), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)
    )
    return out.select("doc_id", "n_words", "places", "notices", base.alias("base_labels"), every.alias("labels"), score.alias("score"))
