"""Learnt sentence boundaries in four languages, and their statistics by hand."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from innsight.operators import boundaries as bd

SENTENCES = {
    "en": [["We met Dr. Miller at 3 p.m. near the lake.", "It was e.g. 3.5 miles away!", "J. R. Smith told us so."], ["lake", "road", "house", "garden"]],
    "de": [["Am 3. Mai kam Hr. Weber an.", "Das Zimmer Nr. 12 war schön.", "Am 14. Juni ging er, bzw. wir gingen."], ["garten", "haus", "strand", "bett"]],
    "fr": [["Le matin Mme. Dupont nous a vus.", "Le prix est de 3.50 euros env. par nuit.", "A. Martin est venu!"], ["maison", "plage", "chambre", "lit"]],
    "es": [["La Sra. Gomez vino ayer.", "El Sr. Ruiz llegó tarde?", "Pagamos 4.20 aprox. por noche."], ["casa", "playa", "cuarto", "cama"]],
}


#: Words that close the sentences above, and so have to be met without a stop as well.
LAST = ["lake", "us", "so", "an", "schön", "gingen", "vus", "nuit", "ayer", "noche", "away", "venu", "tarde"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = []
    for i in range(800):
        known, nouns = SENTENCES[list(SENTENCES)[i % 4]]
        parts = [rng.choice(known)]
        parts += [" ".join(rng.choice(nouns + LAST) for _ in range(6)).capitalize() + "." for _ in range(4)]
        if i % 5 == 0:
            parts.insert(rng.randint(1, 4), f"Wir zahlten {rng.randint(2, 90)}.")
        rows.append((str(i), 0, " ".join(parts), len(parts)))
    return spark.createDataFrame(rows, "property_id string, review_idx int, review_text string, n int")


def test_abbreviations_initials_ordinals_and_decimals_stay_whole(spark, corpus):
    known = bd.learn(corpus)
    assert {"dr", "hr", "nr", "mme", "sra", "sr", "p.m", "e.g"} <= known.abbreviations
    assert not known.abbreviations & {"garten", "lit", "house", "cama", "schön", "so", "an", "gingen"}
    assert {"mai", "juni"} <= known.after_numbers and not known.after_numbers & {"garten", "haus"}
    for of, _ in SENTENCES.values():
        assert bd.split_text(" ".join(of), known) == of
        assert bd.split_text("\n ".join(of).lower(), known) == [s.lower() for s in of]
    cut = bd.split_learnt(corpus, known, keep=("n",))
    assert cut.groupBy("property_id", "n").count().where("count != n").count() == 0
    plain = bd.split_text(" ".join(SENTENCES["en"][0]), bd.Boundaries())
    assert len(plain) > 3


def test_statistics_by_hand(corpus):
    counts, total, stops = {}, 0, 0
    for r in corpus.collect():
        for token in r["review_text"].lower().split():
            token = token.strip("\"'([{«„“‚‘").rstrip("\"')]}»“”’,;:")
            if re.fullmatch(r"[^\W\d_][^\W\d_.'-]*(?:[.'-][^\W\d_.'-]*)*", token):
                plain, stop = token.removesuffix("."), token.endswith(".")
                have = counts.setdefault(plain, [0, 0])
                have[0 if stop else 1] += 1
                total, stops = total + 1, stops + stop
    rate = stops / total
    got = {r["type"]: r for r in bd.abbreviation_scores(bd.type_counts(corpus)).collect()}
    assert set(got) == {w for w, (a, _) in counts.items() if a}
    for word, r in got.items():
        a, b = counts[word]
        assert (r["with_stop"], r["without_stop"]) == (a, b)
        ratio = 2 * (a * math.log(0.99 / rate) + b * math.log((1 - 0.99) / (1 - rate)))
        letters, inner = len(word.replace(".", "")), word.count(".")
        assert r["ratio"] == pytest.approx(ratio, rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(ratio * math.exp(-letters) * (inner + 1) * letters ** -b, rel=1e-9, abs=1e-12)


def test_split_keeps_every_word(spark):
    known = bd.Boundaries(frozenset({"dr"}), frozenset({"mai"}))
    cases = {
        "": [], " \n ": [], "no end": ["no end"], "one. two": ["one.", "two"], 'he said "go." then left.': ['he said "go."', "then left."],
        "wait... what?! yes": ["wait...", "what?!", "yes"], "dr. x am 3. mai. b. end": ["dr. x am 3. mai.", "b. end"], "3. haus": ["3.", "haus"],
    }
    for text, want in cases.items():
        assert bd.split_text(text, known) == want
    rows = spark.createDataFrame([("p", 0, None), ("p", 1, ""), ("p", 2, "a bee. c d"), ("p", 2, "a bee. c d")], "property_id string, review_idx int, review_text string")
    got = bd.split_learnt(rows, known).orderBy("sent_idx").collect()
    assert [(r["review_idx"], r["sent_idx"], r["sentence_text"]) for r in got] == [(2, 0, "a bee.")] * 2 + [(2, 1, "c d")] * 2
    assert bd.learn(rows.limit(0)) == bd.Boundaries() and bd.learn(rows.where(F.col("review_text").isNull())) == bd.Boundaries()


def test_texts_are_read_once_to_learn(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = [("at 5. may, approx. noon. Then more.",), (None,), ("",), ("on 6. may approx. there. x",)]
    texts = spark.createDataFrame(rows, "review_text string")
    counts = bd.after_number_counts(texts).collect()
    assert {(r["type"], r["after"], r["n"]) for r in counts} >= {("may", 2, 2), ("approx", 0, 2), ("noon", 0, 1)}
    bd.learn(texts.mapInArrow(seen, texts.schema))
    assert reads.value == len(rows)
