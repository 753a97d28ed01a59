"""Split texts, their pairs in blocks and their vectors, against the operators on plain tables; what stays on disk."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import topics as tp
from innsight.operators import word_vectors as wv
from innsight.sources.shared import discarded, stored

WORDS = ["Pool", "swim", "water", "towel", "bed", "sleep", "pillow", "night", "wifi", "router", "signal", "the", "and", "été", "straße", "x_1", "7"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a" if i % 7 else None, " ".join(rng.choice(WORDS, rng.integers(0, 14)))) for i in range(400)]
    rows += [(400, "a", None), (401, "a", ""), (402, "a", "... !"), (3, "a", "pool, swim; POOL"), (403, "a", "never seen before"), (404, "a", "7")]
    return spark.createDataFrame(rows, "id int, source string, sentence_text string").repartition(3)


@pytest.fixture
def small(spark, monkeypatch, request):
    """Blobs, chunks and blocks of a few rows each."""
    if request.param:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    for name, value in (
        ("BLOB_ROWS", 3), ("CHUNK_WORDS", 90), ("GROUP_WORDS", 400), ("PIECE_WORDS", 4), ("PLACES_HELD", 50), ("BLOB_PAIRS", 5), ("PART_WORDS", 7), ("BLOB_VECTORS", 2),
    ) if request.param else ():
        monkeypatch.setattr(wv, name, value)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("small", [False, True], indirect=True)
def test_split_texts_give_what_plain_ones_give(texts, small):
    """However texts, pairs and vectors are cut into blobs."""
    split = wv.split_texts(texts, ("id", "source"), marks=[["pool", "bed"], ["été"], ["pool"]])
    counts, plain_counts = wv.word_counts(split), wv.word_counts(texts)
    assert sorted(counts.collect()) == sorted(plain_counts.collect())
    assert split.words.select("chunk").distinct().count() > 3 or not small

    plain = wv.pair_counts(texts, plain_counts)
    pairs = wv.pair_counts(split, counts)
    names = {r["id"]: r["word"] for r in pairs.names.collect()}
    assert sorted(names) == list(range(pairs.words)) and (pairs.pieces > 3) == small
    got = {}
    for r in pairs.blocks.collect():
        low, n = wv._low(bytes(r["low"])), wv._unpacked(bytes(r["n"]), "<u8")
        for code, times in zip(low.tolist(), n.tolist(), strict=True):
            key = frozenset((names[(code >> 16) * pairs.pieces + r["a"]], names[(code & 0xFFFF) * pairs.pieces + r["b"]]))
            assert len(key) == 2 and key not in got
            got[key] = times
    assert got == {frozenset((r["word"], r["context"])): r["n"] for r in plain.collect()}
    of = {r["word"]: r["of_word"] for r in plain.collect()}
    sums = {names[k * pairs.pieces + r["piece"]]: int(x) for r in pairs.sums.collect() for k, x in enumerate(wv._unpacked(bytes(r["of"]), "<u8")) if x}
    assert sums == of and pairs.total == sum(of.values())

    words, plain_words = wv.fit_words(wv.ppmi(pairs), dims=8), wv.fit_words(wv.ppmi(plain), dims=8)
    want = {r["word"]: np.array(r["vector"]) for r in plain_words.collect()}
    found = {r["word"]: np.array(r["vector"]) for r in words.collect()}
    assert found.keys() == want.keys()
    for word, vector in want.items():
        np.testing.assert_allclose(np.abs(found[word]), np.abs(vector), atol=1e-6)

    meant = wv.with_sentence_vectors(split, words, counts, ("id", "source")).collect()
    by_hand = wv.with_sentence_vectors(texts, words, counts, ("id", "source")).collect()

    def told(rows, **more):
        return sorted(((r["id"], r["source"] or "", r["vector"] is None, [round(x, 5) + 0.0 for x in r["vector"] or []]) for r in rows), key=repr)

    left, right = told(meant), told(by_hand)
    assert [x[:3] for x in left] == [x[:3] for x in right] and len(left) == texts.count()
    for x, y in zip(left, right, strict=True):
        np.testing.assert_allclose(x[3], y[3], atol=2e-5)
    marks = {(r["id"], r["marks"]) for r in meant}
    held = {r["id"]: [set(r["w"] or []), 0] for r in texts.where("id <> 3").select("id", wv.words_of(F.col("sentence_text")).alias("w")).collect()}
    assert {x for x in marks if x[0] != 3} == {(i, 1 * bool({"pool", "bed"} & w) + 2 * ("été" in w) + 4 * ("pool" in w)) for i, (w, _) in held.items()}


def test_nothing_known(spark, texts):
    for rows in (texts.limit(0), texts.where("id in (400, 401, 402)"), texts):
        split = wv.split_texts(rows, ("id",))
        counts = wv.word_counts(split, min_count=1000)
        words = wv.fit_words(wv.ppmi(wv.pair_counts(split, counts)), dims=8)
        assert words.count() == 0
        meant = wv.with_sentence_vectors(split, words, counts, ("id",))
        assert meant.count() == rows.count() and meant.where("vector is not null").count() == 0
    with pytest.raises(ValueError, match="more than 63"):
        wv.split_texts(texts, ("id",), marks=[["a"]] * 64)


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return sum(os.path.getsize(f) for f in files.split("\n") if "shuffle_" in f and os.path.exists(f))


def test_storing_leaves_no_shuffled_rows(spark):
    """Shuffles of every step stayed until the driver's garbage was collected, and filled the disk."""
    before = shuffled(spark)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    table = stored(spark.range(300_000).groupBy((F.col("id") % 200_000).alias("k")).count(), "counted")
    assert table.count() == 200_000 and spark.conf.get(setting, None) == was
    end = time.time() + 20
    while shuffled(spark) > before + 100_000 and time.time() < end:
        time.sleep(0.2)
    assert shuffled(spark) <= before + 100_000
    files = [f.removeprefix("file:") for f in table.inputFiles()]
    discarded(table)
    assert files and not any(os.path.exists(f.replace("//", "/")) for f in files)


def test_english_flag_of_split_texts(spark, texts):
    """Texts that are not at hand are told by a column."""
    vectors = spark.createDataFrame([(1, True, [1.0, 0.0]), (2, False, [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, True, None)], "id int, fine boolean, vector array<double>")
    topics = spark.createDataFrame([("t", [1.0, 0.1])], "topic string, vector array<double>")
    assert [r["id"] for r in tp.topics_by_vector(vectors, topics, keep=("id",), english_col="fine").collect()] == [1]
