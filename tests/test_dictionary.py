"""Dictionaries against a test of every term in every text."""

import random
import time

import pytest

from innsight.operators import dictionary as dy

TEXTS = [(1, "She sells SEA shells; he sees the sea."), (2, None), (3, ""), (4, "ushers"), (4, "ushers"), (5, "aaaa"), (6, "Straße é 漢字 end")]
TERMS = ["he", "she", "hers", "sea", "sea", "aa", "Sea Shells", "", None, "zz", "漢字", "é", "end"]


def by_hand(texts, terms):
    out = []
    for key, text in texts:
        low = (text or "").lower()
        for term in {t.lower() for t in terms if t}:
            places = [i for i in range(len(low)) if low.startswith(term, i)]
            if places:
                out.append((key, term, places[0], len(places)))
    return sorted(out)


def frames(spark, texts=TEXTS, terms=TERMS):
    return spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")


@pytest.mark.parametrize("size", [500_000, 3])
def test_terms_by_hand_in_one_or_several_automata(spark, size):
    texts, terms = frames(spark)
    got = dy.find_terms(texts, terms, ["id"], size=size)
    assert got.columns == ["id", "term", "first", "n"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(TEXTS, TERMS)
    assert dy.find_terms(texts, terms.limit(0), ["id"]).count() == 0 and dy.find_terms(texts.limit(0), terms, ["id"]).count() == 0


def test_a_hundred_thousand_terms_cost_one_walk(spark):
    rng = random.Random(1)
    letters = "abcdefgh"
    terms = sorted({"".join(rng.choices(letters, k=rng.randint(5, 8))) for _ in range(120_000)})[:100_000]
    texts = [(i, "".join(rng.choices(letters + " ", k=400))) for i in range(30)]
    assert len(terms) == 100_000
    got = dy.find_terms(*frames(spark, texts, terms), ["id"])
    assert sorted((r["id"], r["term"]) for r in got.collect()) == sorted((i, t) for i, text in texts for t in terms if t in text)
    few, many = dy.automaton(terms[:10]), dy.automaton(terms)
    long = "".join(rng.choices("xyz ", k=2_000_000))
    start = time.perf_counter()
    dy.occurrences(few, long)
    middle = time.perf_counter()
    dy.occurrences(many, long)
    assert time.perf_counter() - middle < 20 * (middle - start) + 1


def test_topics_entities_and_mentions(spark):
    sentences = spark.createDataFrame(
        [("p", "s1", "the Pool was warm, the towel too"), ("p", "s2", "wifi"), ("p", "s3", "nothing"), ("p", "s4", "ééééé pool")],
        "property_id string, sentence_id string, sentence_text string",
    )
    terms = spark.createDataFrame([("water", "pool"), ("water", "towel"), ("heat", "warm"), ("net", "wifi"), ("net", "router"), ("any", "w")], "topic string, term string")
    got = sorted(tuple(r)[1:] for r in dy.topics_by_terms(sentences, terms).collect())
    assert got == [("s1", "any", 1.0), ("s1", "heat", 1.0), ("s2", "any", 1.0), ("s2", "net", 0.5)]
    assert dy.topics_by_terms(sentences, terms, top_n=None).count() == 5
    messages = spark.createDataFrame([(1, 0, "Rome and LONDON, rome"), (1, 1, "occupancy in Rome")], "conv_id int, turn int, text string")
    kinds = spark.createDataFrame([("place", "rome", "Rome"), ("place", "roma", "Rome"), ("place", "london", "London"), ("metric", "occupancy", "occupancy")], "kind string, term string, entity string")
    found = sorted(tuple(r) for r in dy.entities_by_terms(messages, kinds).collect())
    assert found == [(1, 0, "place", "London", 9), (1, 0, "place", "Rome", 0), (1, 1, "metric", "occupancy", 0), (1, 1, "place", "Rome", 13)]
    asked = spark.createDataFrame([("q1", "rome"), ("q1", "occupancy"), ("q2", "london"), ("q3", "rome")], "query string, term string")
    hits = dy.mentions_by_terms(messages, asked, spark.createDataFrame([("q1",), ("q2",)], "query string"), ["turn"])
    assert sorted(tuple(r) for r in hits.collect()) == [("q1", 0, 1), ("q1", 1, 2), ("q2", 0, 1)]
