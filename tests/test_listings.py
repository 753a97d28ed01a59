"""Features, the rating model, documents and retrieval on small frames."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import documents as dc
from innsight.operators import explain as ex
from innsight.operators import features as ft
from innsight.operators import retrieval as rt
from innsight.plans import ingestion, rating_insights as ri
from innsight.sources import tables
from innsight.sources.shared import shared_folder, stored
from suite import derive

AMENITIES = '[{"group_name":"Bath","items":[{"name":"Hair dryer, wall","value":"x"},{"name":null}]},{"group_name":"None","items":null},{"items":[{"name":"HDTV"},{"name":"Wide TV"},{"name":"Wi-Fi 5.0"}]}]'
LISTING = (
    "property_id string, price double, currency string, guests double, cancellation_policy string, "
    "category_rating string, is_super_host boolean, ratings string, amenities string"
)


def one(spark, **changes):
    row = {"property_id": "1", "price": 100.0, "currency": "EUR", "guests": 2.0, "cancellation_policy": None,
           "category_rating": None, "is_super_host": True, "ratings": "4.5", "amenities": AMENITIES, **changes}
    df = spark.createDataFrame([tuple(row.values())], LISTING)
    return ft.listing_features(df, ft.fx_rates(spark)).first()


def test_prices(spark):
    assert one(spark)["price_per_guest"] == pytest.approx(52.5)
    assert one(spark, currency=None)["price_usd"] == 100.0
    assert one(spark, currency="XXX")["price_usd"] is None
    for guests in (None, 0.0, -1.0):
        assert one(spark, guests=guests)["price_per_guest"] == pytest.approx(105.0)


@pytest.mark.parametrize(
    "policy, bucket",
    [("Partial refund, later NO REFUND", "strict"), ("partial refund", "moderate"), ("Full Refund", "flexible"), ("?", "unknown"), (None, "unknown")],
)
def test_cancellation(spark, policy, bucket):
    assert one(spark, cancellation_policy=policy)["cancellation_bucket"] == bucket


def test_category_ratings_and_casts(spark):
    row = one(spark, category_rating='[{"name":"Cleanliness","value":"4.9"},{"name":"Check-in","value":"4.1"}]', ratings="bad")
    assert (row["cat_cleanliness"], row["cat_checkin"], row["cat_communication"]) == (4.9, 4.1, None)
    assert row["ratings"] is None and row["is_super_host"] == 1.0


def test_amenities(spark):
    rows = [("1", AMENITIES), ("2", "no json"), ("3", None), ("4", '[{"items":[{"name":"Pool"}]}]')]
    df = spark.createDataFrame(rows, "property_id string, amenities string")
    items = sorted((r["property_id"], r["name"]) for r in ft.amenity_items(df).collect())
    assert items == [("1", "hair dryer"), ("1", "tv"), ("1", "tv"), ("1", "wi-fi 5.0"), ("4", "pool")]
    top = [tuple(r) for r in ft.top_amenities(ft.amenity_items(df), 2).collect()]
    assert top == [("tv", 2), ("hair dryer", 1)]
    flags, columns = ft.with_amenities(df, 10, ["Sauna"])
    assert columns == ["amen_hair_dryer", "amen_pool", "amen_sauna", "amen_tv", "amen_wi_fi_5_0"]
    got = {r["property_id"]: [r[c] for c in columns] for r in flags.collect()}
    assert got == {"1": [1, 0, 0, 1, 1], "2": [0] * 5, "3": [0] * 5, "4": [0, 1, 0, 0, 0]}


def test_amenity_columns_do_not_clash():
    columns = ft.amenity_columns(["a b", "a-b", "a.b"])
    assert sorted(columns.values()) == ["amen_a_b", "amen_a_b_2", "amen_a_b_3"]


@pytest.fixture(scope="module")
def rated(spark):
    """Ratings that follow one feature up and another down; a third is constant."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        up, down = float(rng.normal()), float(rng.normal())
        rows.append((f"p{i}", up if i % 10 else None, down, 7.0, "a" if i % 3 else "b", 3 + up - 0.5 * down + 0.01 * float(rng.normal())))
    df = spark.createDataFrame(rows, "property_id string, up double, down double, flat double, kind string, ratings double")
    return df, ri.fit_ratings(df, ["up", "down", "flat"], ["kind"])


def test_impacts_add_up_to_the_prediction(rated):
    df, fitted = rated
    insights = ri.explain_all(df, fitted).groupBy("property_id").agg(
        F.sum("current_impact").alias("impact"), F.sum("importance_pct").alias("share")
    )
    predicted = fitted.model.transform(df).select("property_id", "prediction")
    intercept = fitted.model.stages[-1].intercept
    for row in insights.join(predicted, "property_id").collect():
        assert row["impact"] + intercept == pytest.approx(row["prediction"], abs=1e-9)
        assert row["share"] == pytest.approx(100)


def test_trends_gains_and_order(rated):
    df, fitted = rated
    rows = ri.explain_all(df.filter("property_id = 'p1'"), fitted).orderBy("position").collect()
    trend = {r["name"]: r["market_trend"] for r in rows}
    assert trend["up__imp"].startswith("Positive") and trend["down__imp"].startswith("Negative") and trend["flat__imp"] == "Neutral"
    shares = [r["importance_pct"] for r in rows]
    assert shares == sorted(shares, reverse=True)
    slots = {s.name: s for s in fitted.slots}
    scaled = {r["name"]: r for r in rows}
    up = slots["up__imp"]
    assert scaled["up__imp"]["opportunity"] == pytest.approx(up.coef * up.top_scaled - scaled["up__imp"]["current_impact"])
    threshold = np.quantile([r["ratings"] for r in df.collect()], 0.8, method="inverted_cdf")
    top = [r["down"] for r in df.collect() if r["ratings"] >= threshold]
    assert slots["down__imp"].top_value == pytest.approx(np.mean(top))
    assert ri.explain_all(df.filter("property_id = 'p1'"), fitted, top_k=2).count() == 2


def test_leave_out_and_feeds(spark, rated):
    df, fitted = rated
    assert ex.training_rows(df, leave_out="p3").count() == 199
    insights = spark.createDataFrame(
        [("p", "amen_hot_tub__imp", 1.0, 0.256, "Neutral", -0.4, 0.3, 80.0), ("p", "price", None, None, "Neutral", 0.1, 0.005, 20.0)],
        "property_id string, name string, my_value double, market_avg double, market_trend string, current_impact double, opportunity double, importance_pct double",
    )
    assert [r["line"] for r in ex.insight_lines(insights).orderBy("position").collect()] == [
        "1. Hot Tub (80%) - You: 1.0, Avg: 0.26, Impact: -0.40 | Opp: +0.30",
        "2. Price (20%) - You: N/A, Avg: N/A, Impact: +0.10",
    ]
    assert [r["feature"] for r in ex.gain_feed(insights).collect()] == ["amen_hot_tub__imp"]
    assert [r["position"] for r in ex.impact_feed(insights, 1).collect()] == [1]


def test_combined_report(spark):
    insights = spark.createDataFrame([("1", 1, "price")], "property_id string, position int, name string")
    for c in ("my_value", "market_avg", "current_impact", "opportunity", "importance_pct"):
        insights = insights.withColumn(c, F.lit(1.0))
    insights = insights.withColumn("market_trend", F.lit("Neutral"))
    reports = spark.createDataFrame([("1", "{}")], "property_id string, payload_json string")
    hotels = spark.createDataFrame([("ABB_1",), ("BKG_1",)], "hotel_id string")
    got = {r["hotel_id"]: r for r in ri.combined_report(reports, insights, hotels).collect()}
    assert got["ABB_1"]["payload_json"] == "{}" and got["ABB_1"]["error"] is None
    assert got["BKG_1"]["insights_json"] is None and "ABB_" in got["BKG_1"]["error"]


def test_documents_and_upsert(spark):
    hotels = spark.createDataFrame(
        [(7, None, "nice", "Rome", None, None, ["pool", "gym"], [("good", "Ann"), (None, "Bob"), ("bad", "Cy")]), (8, "B", None, "Oslo", "NO", 8.5, None, None)],
        "hotel_id long, title string, description string, city string, country string, review_score double, most_popular_facilities array<string>, top_reviews array<struct<review:string,reviewer_name:string>>",
    )
    docs = {r["doc_id"]: r for r in ingestion.build_corpus(hotels, None).collect()}
    assert docs["BKG_7"]["text"] == "Hotel: Unknown Hotel. Location: Rome, Unknown. Rating: None. Facilities: pool, gym. Description: nice"
    assert docs["BKG_7"]["rating"] == 0.0 and docs["BKG_8"]["rating"] == 8.5
    assert {d for d in docs if "_R" in d} == {"BKG_7_R0", "BKG_7_R2"}
    assert ingestion.build_corpus(hotels, None, city="Oslo").count() == 1
    path = shared_folder(spark, "test-corpus")
    ingestion.ingest(spark, path, hotels, None, version=1)
    changed = dc.booking_hotel_documents(hotels.filter("hotel_id = 8")).withColumn("text", F.lit("new"))
    tables.upsert_documents(spark, path, changed, 2)
    stored = {r["doc_id"]: r["text"] for r in spark.read.parquet(path).collect()}
    assert stored["BKG_8"] == "new" and stored["BKG_7"].startswith("Hotel: Unknown") and len(stored) == 4
    tables.drop_namespaces(spark, path, ["booking_reviews", "absent"])
    assert spark.read.parquet(path).count() == 2
    kept = dc.clear_namespaces(ingestion.build_corpus(hotels, None), ["booking_reviews"])
    assert kept.count() == 2


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = [(f"d{i}", "a" if i % 3 else "b", [float(x) for x in rng.normal(size=5)]) for i in range(300)] + [("zero", "a", [0.0] * 5)]
    queries = [(f"q{i}", "a" if i % 2 else "b", [float(x) for x in rng.normal(size=5)]) for i in range(4)]
    corpus = spark.createDataFrame(docs, "doc_id string, namespace string, vector array<double>").repartition(7)
    asked = spark.createDataFrame(queries, "query_id string, namespace string, vector array<double>")
    for match_on in ([], ["namespace"]):
        got = {}
        for r in rt.search_top_k(asked, corpus, 4, match_on).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        for qid, ns, q in queries:
            scored = [
                (-round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9), d)
                for d, n, v in docs if any(v) and (not match_on or n == ns)
            ]
            assert got[qid] == [d for _, d in sorted(scored)[:4]]


def test_hotel_reviews_fall_back(spark):
    corpus = spark.createDataFrame(
        [("r1", "airbnb_reviews", "X_1", [1.0, 0.0]), ("r2", "booking_reviews", "BKG_2", [1.0, 1.0]), ("r3", "airbnb_reviews", "BKG_2", [1.0, 0.0])],
        "doc_id string, namespace string, hotel_id string, vector array<double>",
    )
    asked = spark.createDataFrame(
        [("q1", "X_1", [1.0, 0.0]), ("q2", "BKG_2", [1.0, 0.0]), ("q3", "BKG_3", [1.0, 0.0])], "query_id string, hotel_id string, vector array<double>"
    )
    got = {(r["query_id"], r["doc_id"]) for r in rt.hotel_reviews(asked, corpus).collect()}
    assert got == {("q1", "r1"), ("q2", "r2")}


def test_competitors_use_the_whole_city_when_the_short_list_is_too_short(spark):
    rows = [(f"BKG_{i:02d}", f"Grand {i:02d}", "Rome", "booking_hotels") for i in range(10)] + [("BKG_99", "Other", "Rome", "booking_hotels")]
    docs = spark.createDataFrame(rows, "hotel_id string, title string, city string, namespace string")
    asked = spark.createDataFrame([("me", "grand", "rome"), ("you", "other", "ROME")], "hotel_id string, hotel_name string, city string")
    got = {}
    for r in rt.city_competitors(asked, docs, k=2, shortlist=4).orderBy("hotel_id", "position").collect():
        got.setdefault(r["hotel_id"], []).append(r["competitor_id"])
    assert got == {"me": ["BKG_99"], "you": ["BKG_00", "BKG_01"]}


def test_a_name_of_a_city_is_answered_once(spark, monkeypatch):
    """Requests of one name share an answer, found in heads of the city that grow; brute force agrees."""
    def title(i):
        return "Unknown Hotel" if i < 60 or i % 4 == 0 else f"Hotel {i % 50}"

    hotels = [(f"BKG_{i:04d}", title(i), "Rome", "booking_hotels") for i in range(400)]
    hotels += [("ABB_1", "Flat", "Rome", "airbnb_hotels"), ("ABB_2", None, "Rome", "airbnb_hotels"), ("ABB_3", "Flat", None, "airbnb_hotels")]
    docs = spark.createDataFrame(hotels, "hotel_id string, title string, city string, namespace string")
    asked = docs.select("hotel_id", F.col("title").alias("hotel_name"), "city").unionByName(
        spark.createDataFrame([("x", "o", "ROME"), ("y", "none", "Paris"), ("z", None, "Rome"), ("w", "l", "rome")], "hotel_id string, hotel_name string, city string")
    )
    tried = []

    def counted(df, name):
        kept = stored(df, name)
        if name == "city-names":
            tried.append(kept.count())
        return kept

    monkeypatch.setattr(rt, "stored", counted)
    got = {}
    for r in rt.city_competitors(asked, docs, k=3, shortlist=4).collect():
        got.setdefault(r["hotel_id"], {})[r["position"]] = r["competitor_id"]
    want = {}
    ranked = sorted((h for h in hotels if h[1] and h[2]), key=lambda h: (h[3] != "booking_hotels", h[0]))
    for r in asked.collect():
        if r["hotel_name"] is not None and (r["city"] or "").lower() == "rome":
            left = [h[0] for h in ranked if r["hotel_name"].lower() not in h[1].lower()][:3]
            want[r["hotel_id"]] = dict(enumerate(left, 1))
    assert got == {h: found for h, found in want.items() if found}
    assert got["BKG_0000"][1] == "BKG_0061" and "w" in want and "w" not in got
    assert tried[0] == 54 and all(later <= 8 for later in tried[1:])  # names, not requests


def test_metrics(spark):
    rows = [(4.5, "Rating: 3"), (0.0, "score  3.5"), (None, "none")]
    df = spark.createDataFrame(rows, "r double, t string")
    assert [r[0] for r in df.select(rt.rating_metric(F.col("r"), F.col("t"))).collect()] == [4.5, 3.5, None]
    prices = spark.createDataFrame([("$1,200.50", ""), (None, "Price: $99.99"), ("n/a", "rate: 80")], "p string, t string")
    assert [r[0] for r in prices.select(rt.price_metric(F.col("p"), F.col("t"))).collect()] == [1200.5, 99.99, 80.0]


def test_lines_are_shuffled_to_their_customer_once(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("region", [(0, "ASIA")], "r_regionkey long, r_name string")
    put("nation", [(0, "JAPAN", 0)], "n_nationkey long, n_name string, n_regionkey long")
    customers = [(k, f"c{k}", 0, "MACHINERY", 10.0) for k in (1, 2, 3)]
    put("customer", customers, "c_custkey long, c_name string, c_nationkey long, c_mktsegment string, c_acctbal double")
    put("orders", [(10, 1), (11, 1), (12, 2), (13, None), (14, 9)], "o_orderkey long, o_custkey long")
    put("part", [(1, "red tin", "PROMO"), (2, "Red tin", "PROMO"), (3, "red tin", "LARGE"), (4, None, "LARGE"), (5, "red tin", "PROMO")],
        "p_partkey long, p_name string, p_type string")
    lines = [(10, 1), (10, 1), (11, 5), (11, 2), (11, 4), (12, 3), (12, 8), (13, 1), (14, 1), (None, 1)]
    put("lineitem", lines, "l_orderkey long, l_partkey long")
    listings = derive.feature_listings(spark, str(tmp_path))
    plan = listings._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and not [k for k in keys if "name#" in k]
    found = {
        r.property_id: r.amenities and [i.get("name") for i in json.loads(r.amenities)[0]["items"]] for r in listings.collect()
    }
    assert found == {"1": [None, "Wide TV Red tin", "Wide TV red tin"], "2": ["Red Tin"], "3": None}
