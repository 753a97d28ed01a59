"""Column functions on hand-made values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from innsight.functions import ids, reviews, text, vectors


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_split_reviews(spark):
    cases = [
        (None, []),
        ("  \n ", []),
        ('["a good stay", {"text":"nice"}, 3]', ["a good stay", "nice"]),
        ('[{"review":"", "comment":"c"}, {"x":1}, "5", ["y"]]', ["c", '{"x":1}', "5"]),
        ('"one review"', ["one review"]),
        ("1. Clean room 2. Loud street", ["Clean room", "Loud street"]),
        ("first part\n\nsecond part", ["first part", "second part"]),
        ("left|right", ["left", "right"]),
        ("up---down--- ", ["up", "down"]),
        ("a|b\n\nc", ["a|b", "c"]),
        ("too short", []),
        ("a single long review without marks", ["a single long review without marks"]),
        ('{"text":"an object on its own"}', ['{"text":"an object on its own"}']),
        ("12345", []),
    ]
    got = values(spark, [c for c, _ in cases], "string", reviews.split_reviews(F.col("x")))
    assert [g[0] for g in got] == [e for _, e in cases]


def test_json_reviews(spark):
    rows = ['["a","b","c"]', "no json", None]
    got = values(spark, rows, "string", reviews.json_reviews(F.col("x"), 2), reviews.json_reviews(F.col("x")))
    assert got == [(["a", "b"], ["a", "b", "c"]), ([], []), ([], [])]


def test_ids(spark):
    rows = ["ABB_40458495", "BKG_177691", "UNKNOWN_123"]
    got = values(spark, rows, "string", ids.raw_id(F.col("x")), ids.source_of(F.col("x")), ids.is_airbnb(F.col("x")))
    assert got == [("40458495", "airbnb", True), ("177691", "booking", False), ("UNKNOWN_123", "unknown", False)]
    (first, second), = values(spark, ["name"], "string", ids.surrogate_id(F.col("x")), ids.surrogate_id(F.lit("name")))
    assert first == second and len(first) == 16


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(raw=st.lists(st.integers(0, 10**12), min_size=1, max_size=20))
def test_ids_round_trip(spark, raw):
    got = values(spark, [str(r) for r in raw], "string", *[ids.raw_id(ids.prefixed(p, F.col("x"))) for p in ("ABB", "BKG")])
    assert got == [(str(r), str(r)) for r in raw]


def test_labels_and_caps(spark):
    rows = ["amen_wi-fi 5ghz_imp", "cat_cleanliness", "amen__hot__tub"]
    assert [g[0] for g in values(spark, rows, "string", text.feature_label(F.col("x")))] == [
        "Wi-Fi 5Ghz", "Cat Cleanliness", "Hot Tub"
    ]
    got = values(spark, ["abcdef", "abc"], "string", text.cap(F.col("x"), 3, "…"), text.cap_with_count(F.col("x"), 4))
    assert got == [("abc…", "abcd\n... [truncated 2 chars]"), ("abc", "abc")]


def test_english_like(spark):
    rows = ["abcdé", "abcéé", "1234", "", "good"]
    assert [g[0] for g in values(spark, rows, "string", text.english_like(F.col("x")))] == [True, False, False, False, True]


def test_fuzzy_contains(spark):
    rows = ["clean room", "the room was clean", "dirty pool", ""]
    hay = F.lit("guests said the room was very clean")
    got = values(spark, rows, "string", text.fuzzy_contains(F.col("x"), hay, text.word_tokens(hay), 0.7))
    assert [g[0] for g in got] == [True, True, False, False]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.text(alphabet="ab .!?\n", max_size=40), min_size=1, max_size=20))
def test_sentences_lose_only_blanks(spark, rows):
    got = values(spark, rows, "string", text.sentences(F.col("x")))
    for original, (parts,) in zip(rows, got):
        assert "".join("".join(parts).split()) == "".join(original.split())
        assert all(p[-1:] in ".!?" for p in parts[:-1])


def test_words_found_keeps_list_order(spark):
    got = values(spark, ["b and a", "none"], "string", text.words_found(F.col("x"), ["a", "b"]), text.count_found(F.col("x"), ["a", "b"]))
    assert got == [(["a", "b"], 2), ([], 0)]


numbers = st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 3))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.lists(numbers, min_size=3, max_size=3), st.lists(numbers, min_size=3, max_size=3)), min_size=1, max_size=10))
def test_cosine_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    for there, back in df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("b"), F.col("a"))).collect():
        assert (there is None) == (back is None)
        if there is not None:
            assert there == pytest.approx(back, abs=1e-12)
            assert -1 - 1e-9 <= there <= 1 + 1e-9
