"""Sentences, topics, the report and the run tables on small frames."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import report as rp
from innsight.operators import sentences as st
from innsight.operators import topics as tp
from innsight.plans import property_comparison as pc
from innsight.sources import tables
from innsight.sources.shared import collect_small, shared_folder

KEYWORDS = {"wifi": ["wifi"], "noise": ["noise", "loud"], "pool": ["pool"]}
REVIEWS = {
    "t": ["The wifi was slow. The pool was great!", "Loud street, terrible noise."],
    "n1": ["Great wifi. Lovely pool.", "wifi broken"],
    "n2": ["The noise was bad.  Great wifi!"],
    "far": ["Great wifi."],
}


def listings(spark):
    rows = [
        (p, json.dumps(r), "far" if p == "far" else "c", 5, "far" if p == "far" else "c", [1.0, float(i)])
        for i, (p, r) in enumerate(REVIEWS.items())
    ]
    return spark.createDataFrame(
        rows, "property_id string, reviews string, geo_bucket string, geo_bucket_res int, h3_5 string, similarity_vec array<double>"
    )


@pytest.fixture(scope="module")
def comparison(spark):
    c = pc.compare_properties(listings(spark), pc.keyword_tagger(KEYWORDS), params={"top_k_neighbors": 2})
    yield c
    c.close()


def test_sentences(spark):
    df = st.split_sentences(st.explode_reviews(listings(spark)))
    got = {(r["property_id"], r["review_idx"], r["sent_idx"]): r["sentence_text"] for r in df.collect()}
    assert got[("t", 0, 0)] == "the wifi was slow."
    assert got[("t", 0, 1)] == "the pool was great!"
    assert got[("n2", 0, 1)] == "great wifi!"
    assert st.split_sentences(st.explode_reviews(listings(spark), max_reviews=1)).count() == len(got) - 2


def test_lexicon_sentiment(spark):
    df = spark.createDataFrame([("clean, clean and dirty",), ("cleaner",), ("So LOUD",)], "sentence_text string")
    assert [r["sentiment_label"] for r in st.lexicon_sentiment(df).collect()] == ["positive", "na", "negative"]


def test_trained_sentiment(spark):
    rows = [("good lovely room", "positive"), ("lovely stay", "positive"), ("bad dirty room", "negative"), ("dirty bath", "negative")]
    labelled = spark.createDataFrame(rows, "sentence_text string, sentiment_label string")
    scored = st.apply_sentiment(labelled, st.fit_sentiment(labelled, dims=1 << 10))
    assert {r["sentence_text"]: r["sentiment_label"] for r in scored.collect()} == dict(rows)


def test_vector_topics_match_brute_force(spark):
    rng = np.random.default_rng(1)
    sentences = [("p", f"s{i}", "some text", [float(x) for x in rng.normal(size=4)]) for i in range(50)] + [("p", "zero", "text", [0.0] * 4)]
    topics = [(f"t{j}", [float(x) for x in rng.normal(size=4)]) for j in range(6)]
    got = tp.topics_by_vector(
        spark.createDataFrame(sentences, "property_id string, sentence_id string, sentence_text string, vector array<double>"),
        spark.createDataFrame(topics, "topic string, vector array<double>"), threshold=0.2, top_n=2,
    )
    expected = set()
    for pid, sid, _, v in sentences:
        if not any(v):
            continue
        scored = [(round(float(np.dot(v, t) / np.linalg.norm(v) / np.linalg.norm(t)), 9), name) for name, t in topics]
        scored = sorted((-s, n) for s, n in scored if s >= 0.2)[:2]
        expected |= {(pid, sid, n, -s) for s, n in scored}
    assert {tuple(r) for r in got.collect()} == expected


def test_embedding_tagger(spark):
    rows = st.lexicon_sentiment(st.split_sentences(st.explode_reviews(listings(spark))))
    topics = spark.createDataFrame([("wifi",), ("pool",)], "topic string")
    tagger = pc.embedding_tagger(topics, st.fit_embedding(rows, dims=4096), threshold=0.2, top_n=1, max_non_ascii=0.2)
    tagged = {(r["property_id"], r["sentence_text"]): r["topic"] for r in tagger(rows).collect()}
    assert tagged[("n1", "lovely pool.")] == "pool"
    assert tagged[("n1", "great wifi.")] == "wifi"
    assert ("n2", "the noise was bad.") not in tagged


def test_gaps(comparison):
    rows = {(r["property_id"], r["topic"]): r for r in comparison.topics.filter("kind = 'weakness'").collect()}
    noise = rows[("t", "noise")]
    assert (noise["target_sentence_topic_assignments"], noise["target_negative_assignments"]) == (1, 1)
    assert (noise["neighbors_sentence_topic_assignments"], noise["neighbors_negative_rate"]) == (1, 1.0)
    wifi = rows[("t", "wifi")]
    assert wifi["target_negative_rate"] == 1.0 and wifi["neighbors_negative_rate"] == pytest.approx(1 / 3)
    assert wifi["negative_rate_gap"] == pytest.approx(2 / 3)
    pool = rows[("n2", "pool")]
    assert pool["target_sentence_topic_assignments"] == 0 and pool["target_negative_rate"] == 0.0
    alone = [r for (p, _), r in rows.items() if p == "far"]  # no neighbours, still reported
    assert alone and all(r["neighbors_sentence_topic_assignments"] == 0 for r in alone)


def test_ranks_are_ordered(comparison):
    for kind, sign in (("weakness", -1), ("strength", 1)):
        rows = comparison.topics.filter(F.col("kind") == kind).orderBy("property_id", "rank").collect()
        gaps = [sign * r["negative_rate_gap"] for r in rows if r["property_id"] == "t"]
        assert gaps == sorted(gaps) and len(gaps) == 3


def test_evidence(comparison):
    rows = comparison.evidence.filter("property_id = 't' and kind = 'weakness'").collect()
    roles = {(r["topic"], r["evidence_role"], r["sentence_text"]) for r in rows}
    assert ("wifi", "target_negative", "the wifi was slow.") in roles
    assert ("pool", "target_positive", "the pool was great!") in roles
    assert ("wifi", "neighbors_negative", "wifi broken") in roles
    assert all(r["evidence_rank"] <= 3 for r in rows)
    own = {r["evidence_property_id"] for r in rows if r["evidence_role"].startswith("target")}
    assert own == {"t"}


def test_payload(comparison):
    payloads = {r["property_id"]: json.loads(r["payload_json"]) for r in pc.payloads(comparison).collect()}
    report = payloads["t"]
    assert [n["neighbor_property_id"] for n in report["neighbors"]["neighbor_list"]] == ["n1", "n2"]
    assert report["text_volume"] == {"target_distinct_sentences_used": 3, "neighbors_distinct_sentences_used": 5}
    first = report["results"]["weaknesses_vs_neighbors"][0]
    assert first["topic"] == "wifi" and first["target_negative_examples"][0]["sentence_text"] == "the wifi was slow."
    assert report["results"]["strengths_vs_neighbors"][0]["rank"] == 1
    assert "neighbor_list" not in payloads["far"]["neighbors"]


def test_run_tables(spark, comparison):
    base = shared_folder(spark, "test-runs")
    first = pc.write_comparison(comparison, base, "r1", dt.datetime(2024, 1, 1))
    pc.write_comparison(comparison, base, "r2", dt.datetime(2024, 1, 2))
    assert set(first) == {"run_id", "runs", "neighbors", "topics", "evidence"}
    assert {r["run_id"] for r in tables.read_topics(spark, base, property_id="t").collect()} == {"r2"}
    assert {r["run_id"] for r in tables.read_topics(spark, base, property_id="t", latest=False).collect()} == {"r1", "r2"}
    assert {r["kind"] for r in tables.read_topics(spark, base, run_id="r1", kind="strength").collect()} == {"strength"}
    assert tables.read_neighbours(spark, base).count() == 12
    evidence = tables.read_evidence(spark, base, "r1", "wifi", "t", limit=2)
    assert evidence.count() == 2
    runs = tables.read_run_table(spark, base, "runs").filter("run_id = 'r1'").collect()
    assert {r["property_id"] for r in runs} == set(REVIEWS)


def test_job_leaves_an_error_row(spark):
    base = shared_folder(spark, "test-runs")
    result = pc.run_comparison(listings(spark), ["nobody"], base, pc.keyword_tagger(KEYWORDS))
    assert result["status"] == "error"
    row, = tables.read_run_table(spark, base, "runs").collect()
    assert row["status"] == "error" and "nobody not found" in row["error_message"] and row["payload_json"] is None
    done = pc.run_comparison(listings(spark), ["t"], base, pc.keyword_tagger(KEYWORDS), params={"top_k_neighbors": 2})
    assert done["status"] == "ok"
    assert {r["property_id"] for r in tables.read_topics(spark, base, done["run_id"]).collect()} == {"t"}


def test_long_messages_and_sentences_are_cut(spark):
    assert len(tables.error_run(spark, ["p"], "x" * 5000).first()["error_message"]) == 2000
    rows = spark.createDataFrame([("y" * 700,), ("y" * 600,)], "sentence_text string")
    assert [len(r[0]) for r in rp.capped_evidence(rows).collect()] == [601, 600]


def test_min_assignments(spark):
    rows = spark.createDataFrame(
        [("a", "x", "negative"), ("b", "x", "positive"), ("a", "y", "positive")], "property_id string, topic string, sentiment_label string"
    )
    near = spark.createDataFrame([("a", "b", 0.9, 1)], "property_id string, neighbor_property_id string, similarity double, rank int")
    assert rp.topic_gaps(rows, near).count() == 2
    assert [r["topic"] for r in rp.topic_gaps(rows, near, min_assignments=2).collect()] == ["x"]


def test_bubble_sizes_fall_back(spark):
    def feed(counts):
        rows = [("p", "weakness", i + 1, f"t{i}", 0.1 * i - 0.1, 1, n) for i, n in enumerate(counts)]
        topics = spark.createDataFrame(
            rows, "property_id string, kind string, rank int, topic string, negative_rate_gap double, "
            "target_sentence_topic_assignments long, neighbors_sentence_topic_assignments long"
        )
        return {r["topic"]: r for r in rp.bubble_feed(topics).collect()}

    equal = feed([0, 0, 0])
    assert {r["bubble_s"] for r in equal.values()} == {30.0}
    assert equal["t0"]["color"] == "green" and equal["t2"]["color"] == "red"
    # eleven values: both quantiles are zero, the range is not
    spread = feed([0] * 19 + [10])
    assert spread["t19"]["bubble_s"] == 1200.0


def test_params():
    assert tables.parse_params("", {"a": 1}) == {"a": 1}
    assert tables.parse_params('{"a": 2, "b": 3}', {"a": 1}) == {"a": 2, "b": 3}
    with pytest.raises(ValueError):
        tables.parse_params("[1]", {})


def test_small_frames_are_checked(spark):
    assert len(collect_small(spark.range(3), 3, "rows")) == 3
    with pytest.raises(ValueError, match="more than 2 rows"):
        collect_small(spark.range(3), 2, "rows")


def test_topics_by_vector_of_any_number(spark, monkeypatch):
    """Ties by name, a threshold, zero vectors and small slices, against a loop by hand."""
    monkeypatch.setattr(tp, "SCORES", 700)
    rng = np.random.default_rng(3)
    topics = [(f"t{i:03d}", [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)] + [("zero", [0.0] * 4), ("t000b", None)]
    topics.append(("a tie", topics[7][1]))
    rows = [("p", f"s{i}", "some text", [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [("p", "none", "text", None), ("p", "flat", "text", [0.0] * 4)]
    rows.append(("p", "same", "text", topics[7][1]))
    sentences = spark.createDataFrame(rows, "property_id string, sentence_id string, sentence_text string, vector array<double>")
    given = spark.createDataFrame(topics, "topic string, vector array<double>")
    got = {}
    for r in tp.topics_by_vector(sentences, given, threshold=0.9, top_n=3).collect():
        got.setdefault(r["sentence_id"], []).append((-r["topic_similarity"], r["topic"]))
    for _, sid, _, v in rows:
        best = []
        for name, t in topics:
            if v and t and any(v) and any(t):
                best.append((-round(float(np.dot(v, t) / np.linalg.norm(v) / np.linalg.norm(t)), 9), name))
        assert sorted(got.get(sid, [])) == sorted(x for x in best if x[0] <= -0.9)[:3]
    assert tp.topics_by_vector(sentences, given.where("topic = 'zero'")).count() == 0
    monkeypatch.setattr(tp, "TOPIC_BYTES", 100)
    with pytest.raises(ValueError, match="bytes"):
        tp.topics_by_vector(sentences, given)
