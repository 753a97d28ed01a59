"""Word vectors, tagging by meaning, and naive Bayes with negation, against counts by hand."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import topics as tp
from innsight.operators import word_sentiment as ws
from innsight.operators import word_vectors as wv
from suite import review_queries as rq

GROUPS = [["pool", "swim", "water", "towel", "lido"], ["bed", "sleep", "pillow", "mattress", "night"], ["wifi", "router", "signal", "stream", "online"]]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        words = list(rng.choice(GROUPS[i % 3], 4, replace=False)) + list(rng.choice(["the", "and", "was", "very"], 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + "."))
    return spark.createDataFrame(rows, "id int, sentence_text string")


def test_pairs_by_hand(spark):
    texts = spark.createDataFrame([("a b a c",), ("B a",), (None,), ("",), ("rare a",)], "sentence_text string")
    counts = wv.word_counts(texts, min_count=2)
    assert {r["word"]: r["n"] for r in counts.collect()} == {"a": 4, "b": 2}
    pairs = wv.pair_counts(texts, counts, window=2)
    assert {(r["word"], r["context"]): r["n"] for r in pairs.collect()} == {("a", "b"): 3, ("b", "a"): 3}
    wide = wv.pair_counts(texts, wv.word_counts(texts, min_count=1), window=3)
    got = {(r["word"], r["context"]): r["n"] for r in wide.collect()}
    assert got[("a", "c")] == 2 and got[("b", "c")] == 1 and got[("a", "rare")] == 1 and ("a", "a") not in got
    total, of = sum(got.values()), Counter()
    for (w, _), n in got.items():
        of[w] += n
    for r in wv.ppmi(wide).collect():
        assert r["ppmi"] == pytest.approx(math.log(r["n"] * total / (of[r["word"]] * of[r["context"]])))
        assert r["ppmi"] > 0


def test_pairs_are_counted_once(spark):
    """What is read again are stored pairs of known words, whose sums need no second count."""
    texts = ["a x b y a", "b a", "b a", "x y z", None, "", "a " * 3 + "c b"]
    rows = spark.createDataFrame([(t,) for t in texts], "sentence_text string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "word string")
    pairs = wv.pair_counts(rows, known, window=2)
    want = Counter()
    for words in ((t or "").split() for t in texts):
        for i, w in enumerate(words):
            for c in words[i + 1 : i + 3]:
                if w != c and {w, c} <= set("abc"):
                    want[(w, c)] += 1
                    want[(c, w)] += 1
    got = pairs.collect()
    assert {(r["word"], r["context"]): r["n"] for r in got} == want and len(got) == len(want)
    of = Counter()
    for (w, _), n in want.items():
        of[w] += n
    assert all((r["of_word"], r["of_context"], r["of_all"]) == (of[r["word"]], of[r["context"]], sum(want.values())) for r in got)
    stored = {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in wv.ppmi(pairs).inputFiles()}
    assert stored == {"pair-counts", "paired-words"}
    assert wv.pair_counts(rows, known.limit(0)).count() == 0


def test_vectors_span_the_matrix(corpus):
    """With as many dimensions as words the products of vectors give the matrix's absolute value."""
    pairs = wv.ppmi(wv.pair_counts(corpus, wv.word_counts(corpus))).collect()
    names = sorted({r["word"] for r in pairs})
    matrix = np.zeros((len(names), len(names)))
    for r in pairs:
        matrix[names.index(r["word"]), names.index(r["context"])] = r["ppmi"]
    spark = corpus.sparkSession
    vectors = wv.fit_words(spark.createDataFrame(pairs), dims=len(names), rounds=1, common=0)
    got = {r["word"]: np.array(r["vector"]) for r in vectors.collect()}
    size, axes = np.linalg.eigh(matrix)
    want = axes @ np.diag(np.abs(size)) @ axes.T
    stacked = np.array([got[n] for n in names])
    np.testing.assert_allclose(stacked @ stacked.T, want, atol=1e-6)


def test_sentences_are_tagged_without_a_shared_word(spark, corpus):
    counts = wv.word_counts(corpus)
    words = wv.fit_words(wv.ppmi(wv.pair_counts(corpus, counts)), dims=8)
    topics = spark.createDataFrame([("water", "pool swim"), ("rest", "bed sleep"), ("net", "wifi router")], "topic string, sentence_text string")
    asked = spark.createDataFrame(
        [(1, "The towel and the lido."), (2, "A mattress, a night!"), (3, "stream online"), (4, "unknown words"), (5, None), (1, "The towel and the lido.")],
        "id int, sentence_text string",
    )
    vectors = wv.with_sentence_vectors(asked, words, counts, ("id",))
    assert vectors.count() == 6 and vectors.where("id in (4, 5) and vector is not null").count() == 0
    tagged = tp.topics_by_vector(
        vectors, wv.with_sentence_vectors(topics, words, counts, ("topic",)), threshold=0.3, top_n=1, keep=("id",)
    )
    assert {(r["id"], r["topic"]) for r in tagged.collect()} == {(1, "water"), (2, "rest"), (3, "net")}


def test_meaning_finds_the_language_of_the_given_sentences(spark):
    """Over 0.9 of the sentences that share no word with their topic are tagged with their own language."""
    rows = rq.topic_by_meaning(spark, "/root/testdata/sf0.01").where("not shares_a_word").collect()
    right = sum(r["sentences"] for r in rows if r["lang"] == r["topic"])
    whole = sum(r["sentences"] for r in rows)
    assert whole > 5000 and right / whole > 0.9


def features_by_hand(text):
    out = []
    for clause in re.split(r"[.,;:!?\n]+", text.lower()):
        words, turned = re.findall(r"[\w']+", clause), False
        for w in words:
            out.append("not_" + w if turned else w)
            turned = turned or w in ws.NEGATIONS
    return out


def test_negation_scope(spark):
    texts = ["It was not clean at all, but quiet.", "No noise! Never cold: warm", "don't go. Go", "nicht sauber; sauber", "", "plain words"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(ws.features(F.col("t"))).collect()]
    assert got == [features_by_hand(t) for t in texts]
    assert got[0] == ["it", "was", "not", "not_clean", "not_at", "not_all", "but", "quiet"]


def labelled(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        good = bool(rng.random() < 0.6)
        word = rng.choice(["clean", "quiet"]) if good else rng.choice(["dirty", "loud"])
        turned = rng.random() < 0.4
        shown = f"not {rng.choice(['dirty', 'loud'] if good else ['clean', 'quiet'])}" if turned else word
        rows.append((i, f"{rng.choice(['The room', 'A bed', 'It'])} was {shown}.", "positive" if good else "negative"))
    return spark.createDataFrame(rows + [(-1, None, "positive"), (-2, "no label", None)], "id int, sentence_text string, sentiment_label string")


def test_weights_and_choice_by_hand(spark):
    rows = labelled(spark)
    weights, priors = ws.fit(rows)
    texts = [(r["sentence_text"], r["sentiment_label"]) for r in rows.collect() if r["sentence_text"] and r["sentiment_label"]]
    n_label = Counter(label for _, label in texts)
    assert priors == {k: pytest.approx(math.log(v / len(texts))) for k, v in n_label.items()}
    n, having = Counter(), Counter()
    for text, label in texts:
        found = features_by_hand(text)
        n.update((f, label) for f in found)
        having.update((f, label) for f in set(found))
    ratio = {}
    for f in {f for f, _ in n}:
        of = sum(having[f, k] for k in n_label)
        ratio[f] = 2 * sum(
            x * math.log(x * len(texts) / (side * n_label[k]))
            for k in n_label for x, side in ((having[f, k], of), (n_label[k] - having[f, k], len(texts) - of)) if x > 0
        )
    chosen = {f for f, r in ratio.items() if r >= ws.LEAST_RATIO}
    assert {"clean", "not_clean", "dirty", "not_dirty"} <= chosen and "room" not in chosen
    totals = {k: sum(n[f, k] + 1 for f in chosen) for k in n_label}
    want = {(f, k): math.log((n[f, k] + 1) / totals[k]) for f in chosen for k in n_label}
    got = {(r["feature"], r["label"]): r["weight"] for r in weights.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_held_out_sentiment_with_negation(spark):
    """Words alone cannot tell "not clean" from "clean"; with negation scope all held-out texts are right."""
    model = ws.fit(labelled(spark))
    held = labelled(spark, 200, seed=9).where("sentiment_label is not null and sentence_text is not null").withColumnRenamed("sentiment_label", "truth")
    out = ws.apply(held, model, ("id",))
    assert out.where("truth != sentiment_label").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "nothing known here"), (3, "nothing known here")], "id int, sentence_text string")
    assert [r["sentiment_label"] for r in ws.apply(odd, model, ("id",)).collect()] == ["positive"] * 4
    with pytest.raises(ValueError, match="no labelled"):
        ws.fit(labelled(spark).where("id < 0 and sentence_text is null"))


def test_texts_are_read_once_to_learn(spark):
    """A model and the counts behind it are stored tables; texts without words count for their label."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = [("good room", "p")] * 30 + [("bad room", "n")] * 20 + [("...", "n"), (None, "p"), ("good", None)]
    texts = spark.createDataFrame(rows, "sentence_text string, sentiment_label string")
    weights, priors = ws.fit(texts.mapInArrow(seen, texts.schema))
    assert reads.value == len(rows)
    assert ws.label_counts(texts) == {"n": 21, "p": 30} and priors == pytest.approx({"n": math.log(21 / 51), "p": math.log(30 / 51)})
    chosen = ws.chosen_features(ws.feature_counts(texts), ws.label_counts(texts)).collect()
    assert {r["feature"] for r in weights.collect()} == {r["feature"] for r in chosen} >= {"good", "bad"}
    assert ws.feature_counts(texts).where("feature is null").count() == 0 and reads.value == len(rows)


def test_vectors_of_rows_are_not_shuffled_and_blocks_change_nothing(corpus, monkeypatch):
    """Sums of 64 doubles per row and task filled the disk; words' vectors now go to chunks and blocks."""
    counts = wv.word_counts(corpus)
    pairs = wv.ppmi(wv.pair_counts(corpus, counts))
    words = wv.fit_words(pairs, dims=8)
    keyed = corpus.select(F.monotonically_increasing_id().alias("id"), "sentence_text")
    meant = wv.with_sentence_vectors(keyed, words, counts, ("id",))
    assert "avg(" not in meant._jdf.queryExecution().toString()
    monkeypatch.setattr(wv, "BLOCK_PAIRS", 7)
    monkeypatch.setattr(wv, "GATHERED", 24)
    monkeypatch.setattr(wv, "CHUNK_BITS", 1)
    want = {r["word"]: r["vector"] for r in words.collect()}
    got = {r["word"]: r["vector"] for r in wv.fit_words(pairs, dims=8).collect()}
    assert got.keys() == want.keys()
    for word, vector in want.items():
        np.testing.assert_allclose(np.abs(got[word]), np.abs(vector), atol=1e-6)
    again = {r["id"]: r["vector"] for r in wv.with_sentence_vectors(keyed, words, counts, ("id",)).collect()}
    weight = {r["word"]: 1e-3 / (1e-3 + r["n"] / sum(c["n"] for c in counts.collect())) for r in counts.collect()}
    for r in meant.select("id", "vector", wv.words_of(F.col("sentence_text")).alias("w")).collect():
        plain = [np.array(want[w]) * weight[w] for w in r["w"] if w in want and w in weight]
        assert (r["vector"] is None) == (again[r["id"]] is None) == (not plain)
        if plain:
            np.testing.assert_allclose(r["vector"], np.mean(plain, axis=0), atol=1e-9)
            np.testing.assert_allclose(again[r["id"]], r["vector"], atol=1e-9)
