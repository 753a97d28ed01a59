"""Cases that once went wrong: repeated ingestion, lonely properties, missing ids, many requests."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from innsight.sources import tables
from innsight.functions import text as tx
from innsight.operators import dictionary as dy
from innsight.operators import documents as dc
from innsight.operators import metric_index as mi
from innsight.operators import neighbours as nb
from innsight.operators import pages as pg
from innsight.operators import retrieval as rt
from innsight.operators import topics as tp
from innsight.plans import ingestion
from innsight.plans import property_comparison as pc
from suite import listing_queries as lq

FLATS = (
    "property_id string, name string, listing_name string, description string, location string, country string, "
    "ratings string, amenities string, guests double, price double, category string, reviews string"
)


def flats(spark):
    def row(pid, name, description):
        return (pid, name, None, description, "Rome centre", "it", "4,5", "[]", 2.0, 90.0, "Entire home",
                '["a review long enough", "another review long enough"]')

    return spark.createDataFrame([row(None, None, "one"), row(None, "Flat", "two"), row(None, "Flat", "three"), row("7", None, "x")], FLATS)


def test_missing_ids_stay_apart(spark):
    hotels, reviews = dc.airbnb_hotel_documents(flats(spark)), dc.airbnb_review_documents(flats(spark))
    ids = {r.doc_id for r in hotels.collect()}
    assert len(ids) == 4 and None not in ids
    got = reviews.collect()
    assert len({r.doc_id for r in got}) == 8 and {r.hotel_id for r in got} == ids


def test_ingestion_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "documents")
    for version in (1, 2):
        counts = {r.namespace: r.documents for r in ingestion.ingest(spark, path, None, flats(spark), version=version).collect()}
        assert counts == {"airbnb_hotels": 4, "airbnb_reviews": 8}
    ingestion.ingest(spark, path, None, flats(spark).limit(1), version=3, clear_existing=False)
    assert spark.read.parquet(path).count() == 12
    broken = flats(spark).withColumn("reviews", F.raise_error(F.lit("unreadable")).cast("string"))
    with pytest.raises(Exception, match="unreadable"):
        ingestion.ingest(spark, path, None, broken, version=4)
    assert spark.read.parquet(path).count() == 12


def test_a_property_alone_in_its_cell_is_reported(spark):
    rows = [("1", "a", [1.0, 0.0], '["the room is dirty. the room is bad."]'), ("2", "a", [1.0, 0.1], '["the room is fine."]'),
            ("3", "b", [0.5, 0.5], '["the room is dirty."]')]
    listings = spark.createDataFrame(rows, "property_id string, geo_bucket string, similarity_vec array<double>, reviews string")
    listings = listings.withColumn("geo_bucket_res", F.lit(8)).withColumn("h3_8", F.col("geo_bucket"))
    out = pc.compare_properties(listings, pc.keyword_tagger({"room": ["room"]}), keep_sentences=False)
    assert {r.property_id for r in out.topics.collect()} == {"1", "2", "3"}
    volume = {r.property_id: r.target_distinct_sentences_used for r in out.volume.collect()}
    assert set(volume) == {"1", "2", "3"} and volume["3"] == 1
    status = out.status.collect()
    assert {(r.max_candidates_cap, r.candidate_sampling_fraction) for r in status} == {(None, 1.0)}
    capped = nb.neighbour_status(listings, listings.select("property_id"), max_candidates=50).collect()
    assert {r.max_candidates_cap for r in capped} == {50}


def test_filters_compare_values(spark):
    docs = spark.createDataFrame(
        [("a", [1.0, 0.0], True, "None"), ("b", [1.0, 0.1], False, "x"), ("c", [1.0, 0.2], True, None)],
        "doc_id string, vector array<double>, flag boolean, tag string",
    )
    asked = spark.createDataFrame([("q", [1.0, 0.0], True, None)], "query_id string, vector array<double>, flag boolean, tag string")
    assert [r.doc_id for r in rt.search_top_k(asked, docs, 5, ["flag"]).orderBy("rank").collect()] == ["a", "c"]
    assert rt.search_top_k(asked, docs, 5, ["tag"]).count() == 0


def test_many_queries_give_what_few_give(spark, monkeypatch):
    docs = spark.range(300).selectExpr("cast(id as string) doc_id", "array(cast(id % 17 as double), 1.0, cast(id % 5 as double)) vector", "id % 3 kind")
    asked = docs.selectExpr("concat('q', doc_id) query_id", "vector", "kind")
    few = [rt.search_top_k(asked, docs, 4, on).collect() for on in ([], ["kind"])]
    monkeypatch.setattr(rt, "MAX_QUERIES", 10)
    monkeypatch.setattr(rt, "BLOCK_ROWS", 64)
    many = [rt.search_top_k(asked, docs, 4, on).collect() for on in ([], ["kind"])]
    assert [sorted(map(tuple, f)) for f in few] == [sorted(map(tuple, m)) for m in many]


def test_any_number_of_names_can_be_looked_up(spark):
    docs = spark.range(1500).selectExpr(
        "'booking_hotels' namespace", "concat('BKG_', lpad(id, 5, '0')) hotel_id", "concat('Hotel Number ', id, ' End') title", "'t' text")
    asked = spark.range(1200).selectExpr("concat('BKG_x', id) hotel_id", "concat('number ', id, ' ') hotel_name")
    twice = asked.unionByName(asked.limit(3)).unionByName(spark.createDataFrame([("BKG_y", ""), ("BKG_z", None)], "hotel_id string, hotel_name string"))
    got = rt.lookup_hotels(twice, docs).collect()
    assert len(got) == 1205
    assert all(r.found_hotel_id == "BKG_" + r.hotel_id[5:].zfill(5) for r in got if r.hotel_id[4] == "x")
    assert all(r.found_hotel_id is None for r in got if r.hotel_id[4] != "x")


def test_pieces_nobody_asks_for_go_before_the_shuffle(spark):
    pieces = spark.createDataFrame([("n", f"p{i}", i) for i in range(5000)], "namespace string, gram string, id long")
    asked = spark.createDataFrame([("n", f"p{i}") for i in range(0, 5000, 100)] + [("m", "p1"), ("n", "p0")], "namespace string, gram string")
    kept = {r.id for r in rt._maybe_asked(pieces, asked).collect()}
    assert set(range(0, 5000, 100)) <= kept and len(kept) < 60
    assert rt._maybe_asked(pieces, asked.limit(0)).count() == 0


def test_tagging_scores_a_sentence_once(spark):
    """The optimiser put all scores, with the lower case once per word, into a filter as well."""
    rows = spark.createDataFrame([("p", "s1", "The cat"), ("p", "s2", "1234"), ("p", "s3", "ünd so über alles"), ("p", "s4", None), ("p", "s5", "xyz")],
                                 "property_id string, sentence_id string, sentence_text string")
    tagged = tp.topics_by_keyword(rows, {"a": ["the", "cat"], "b": ["alles", "xx"]})
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Contains(") == 4
    assert {(r["sentence_id"], r["topic"], r["topic_similarity"]) for r in tagged.collect()} == {("s1", "a", 1.0), ("s3", "b", 0.5)}


def test_white_space_and_letters_as_before(spark):
    texts = ["a b", " a  b\tc\n", "\t", "x y \x0b z", "", "A\r\n b", None, "é\x00ü \x7f", "a\x1cb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(tx.normalise_review(F.col("t")), F.regexp_replace(F.lower("t"), r"\s+", " "),
                      F.regexp_replace("t", r"[\x00-\x7F]+", ""), F.regexp_replace("t", r"[\x00-\x7F]", "")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_blocks_are_scored_in_slices(monkeypatch):
    """All scores of a block and their masks stood in a worker's memory at once."""
    rng = np.random.default_rng(3)
    n = 60
    ids = [f"v{i}" for i in range(n)]
    vec = pa.array(rng.normal(size=(n, 4)).round(1).tolist(), pa.list_(pa.float64()))
    flags = pa.array([True] * n + [False] * n)
    rows = pa.table({"key": pa.array(["k"] * 2 * n), "id": pa.array(ids * 2), "vec": pa.concat_arrays([vec, vec]), "is_target": flags})
    pivots = pa.table({"pivot": pa.array([5, 6, 7]), "lo": [0.1, 0.2, 0.0], "hi": [0.5, 0.9, 3.0], "vec": vec.slice(0, 2).to_pylist() + [None]})
    asked = pa.table({"key": pa.array(["k"] * n), "id": pa.array(ids), "vec": vec, "pivot": pa.array([5] * n), "bound": pa.array(rng.uniform(0, 1, n))})
    whole = mi._score_block(3, True)(rows), mi._left(asked, pivots)
    sizes = []
    best = mi.best_columns
    monkeypatch.setattr(mi, "SCORES", 200)
    monkeypatch.setattr(mi, "best_columns", lambda scores, k, i: (sizes.append(scores.size), best(scores, k, i))[1])
    assert mi._score_block(3, True)(rows).equals(whole[0]) and max(sizes) <= 200
    cut = mi._left(asked, pivots)
    assert cut.equals(whole[1]) and 0 < sum(map(len, cut["others"].to_pylist())) < 3 * n
    assert mi._left(asked, pivots.slice(0, 0))["others"].to_pylist() == [[]] * n and mi._left(asked.slice(0, 0), pivots).num_rows == 0


def test_terms_are_found_in_slices_of_bounded_size():
    """The terms of ten thousand texts stood in a worker's memory at once."""
    texts = ["ab" * 3, None, "", "x" * 50, "cab", "a", None]
    batch = pa.record_batch({"i": pa.array(range(7)), "_text": pa.array(texts)})
    parts = list(dy.slices(batch, "_text", 7))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) == 2
    assert all(sum(len(t or "") for t in p["_text"].to_pylist()[:-1]) <= 7 for p in parts)
    assert list(dy.slices(batch.slice(0, 0), "_text")) == []


def test_review_blocks_are_read_once(spark):
    """The text of a block was worked out twice, and tag patterns were compiled for every piece of it."""
    html = ('<div class="jftiEf"><span class="wiI7pd">first <SPAN>in <span/>side</SPAN> long enough</span> no</div>'
            '<div class="jftiEf"><span class="wiI7pd"><spanner>not the same tag</spanner></span></div>'
            '<div class="jftiEf"><span class="wiI7pd"></span>nothing in it at all</div>'
            '<div class="jftiEf"><span class="wiI7pd">left open to the end</div>')
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "no block")], "page_id int, html string")
    got = pg.page_reviews(pages)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "inline" in plan and not [line for line in plan.splitlines() if "Filter" in line and "wiI7pd" in line]
    assert [(r["page_id"], r["pos"], r["review_text"]) for r in got.orderBy("page_id", "pos").collect()] == [
        (1, 0, "first in side long enough"), (1, 1, "not the same tag"), (1, 3, "left open to the end")]


def test_requested_reviews_are_parsed_once(spark):
    """Every use of the reviews, of which the requests are one, parsed all listings again."""
    plan = lq.hotel_reviews(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "review-vectors-" in plan and "documents.parquet" not in plan


def test_an_upsert_moves_only_documents_that_may_meet_incoming_ones(spark, tmp_path):
    path = str(tmp_path / "documents")
    held = spark.createDataFrame([("a", None, "none"), *[("a", f"d{i}", f"old {i}") for i in range(300)]], "namespace string, doc_id string, text string")
    tables.upsert_documents(spark, path, held, version=1)
    incoming = spark.createDataFrame([("a", "d7", "new b"), ("a", "d7", "new a"), ("a", None, "new none"), ("b", "d8", "other")], held.schema)
    marked = {r.doc_id: r["_meets"] for r in tables._meeting(held, incoming).collect()}
    assert marked["d7"] and marked[None] and sum(marked.values()) < 30
    tables.upsert_documents(spark, path, incoming, version=2)
    found = {(r.namespace, r.doc_id): (r.text, r.version) for r in tables.read_documents(spark, path).collect()}
    assert tables.read_documents(spark, path).count() == len(found) == 302
    assert found["a", "d7"] == ("new a", 2) and found["a", None] == ("new none", 2) and found["b", "d8"] == ("other", 2)
    assert found["a", "d8"] == ("old 8", 1)
