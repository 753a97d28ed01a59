"""Web payloads, pages, conversations, logs and scores on small frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from innsight.operators import conversations as cv
from innsight.operators import evaluation as ev
from innsight.operators import grounding as gr
from innsight.operators import pages as pg
from innsight.operators import toollogs as tl
from innsight.operators import topics as tp
from innsight.operators import webpayloads as wp


def payloads(spark, *items):
    texts = [i if isinstance(i, str) else json.dumps(i) for i in items]
    return spark.createDataFrame(list(enumerate(texts)), "request_id int, payload string")


def test_search_results(spark):
    hit = {"title": "T", "description": "d" * 400, "url": "u"}
    df = payloads(
        spark, {"organic": [hit]}, {"body": {"organic": [hit]}}, {"body": json.dumps({"results": [{"title": "R", "snippet": "s"}]})},
        "A hotel. The stay was long and the hotel was clean. Hotel. nothing here at all to be found today!",
        {"raw": "x room that is mentioned in a long enough sentence?"}, {"organic": []},
    )
    got = {(r["request_id"], r["pos"]): (r["title"], r["snippet"], r["link"]) for r in wp.search_results(df).collect()}
    assert got == {
        (0, 0): ("T", "d" * 300, "u"), (1, 0): ("T", "d" * 300, "u"), (2, 0): ("R", "s", ""),
        (3, 0): ("Result 2", "The stay was long and the hotel was clean.", ""),
        (4, 0): ("Result 1", "x room that is mentioned in a long enough sentence?", ""),
    }


def test_events(spark):
    df = payloads(spark, {
        "events": [{"title": "Jazz", "venue": "Hall"}],
        "organic": [
            {"title": "JAZZ", "description": "x"}, {"title": "Cookie policy"}, {"title": ""},
            {"title": "Fair", "description": "on Sat, Jan 5 at 8", "link": "l"}, {"title": "Expo", "snippet": "12/05/2024"}, {"title": "Run in December"},
        ],
    }, {"error": "down", "events": [{"title": "no"}]})
    got = [(r["name"], r["description"], r["date"], r["link"]) for r in wp.events(df).orderBy("pos").collect()]
    assert got == [
        ("Jazz", "Hall", "Date not specified", None), ("Fair", "on Sat, Jan 5 at 8", "Sat, Jan 5", "l"),
        ("Expo", "12/05/2024", "12/05/2024", ""), ("Run in December", "No description available", "December", ""),
    ]


def test_weather(spark):
    df = payloads(
        spark,
        {"weather": {"temperature": "21", "subtitles": ["a", "Sunny"], "additional_info": [{"type": "Wind", "text": "5"}], "daily_forecast": [{"day": "Mon", "temperature": {"daytime": "9", "nighttime": "1"}}] * 4}},
        {"answer_box": {"snippet": "12 degrees"}}, {"knowledge_graph": {"description": "a city"}},
        {"organic": [{"title": "Weather now", "description": "cold"}, {"title": "News", "description": "20°"}, {"title": "x", "description": "y"}]}, {},
    )
    got = [(r["origin"], r["temperature"], r["conditions"], r["details"], r["summary"]) for r in wp.weather(df).orderBy("request_id").collect()]
    assert got == [
        ("weather", "21", "Sunny", "Wind: 5", None), ("answer_box", None, None, None, "12 degrees"),
        ("knowledge_graph", None, None, None, "a city"), ("organic", None, None, None, "Weather now: cold; News: 20°"), ("none", None, None, None, None),
    ]
    assert wp.forecast(df).count() == 3


def test_local_results_and_panel(spark):
    df = payloads(spark, {"local_results": [{"name": "A", "rating": 4.5, "review_count": 12}] * 7}, {"results": [{"title": "B"}]}, {"knowledge_graph": {"title": "C", "phone": "1"}})
    rows = wp.local_results(df).orderBy("request_id", "pos").collect()
    assert len(rows) == 6 and tuple(rows[0])[2:] == ("A", "4.5", "12", "N/A") and rows[5]["name"] == "B"
    assert [tuple(r) for r in wp.business_panel(df).collect()] == [(2, "C", "N/A", "N/A", "1")]


def test_direct_answer(spark):
    df = payloads(spark, {"answer_box": {"answer": "42"}, "organic": [{"title": "T", "link": "l"}]}, {"answer_box": {}})
    assert [tuple(r) for r in wp.direct_answer(df).orderBy("position").collect()] == [
        (0, 0, "Quick Answer", "42", ""), (0, 1, "T", "", "l")
    ]


def test_date_ranges(spark):
    day = F.lit(dt.date(2024, 5, 15))
    got = spark.range(1).select(
        *[wp.date_range(F.lit(p), day).alias(p) for p in ("this week", "this month", "next week", "May")],
        wp.date_phrase(F.lit("next week"), day).alias("words"), wp.date_phrase(F.lit("May"), day).alias("other"),
    ).first()
    assert tuple(got["this week"]) == (dt.date(2024, 5, 13), dt.date(2024, 5, 19))
    assert tuple(got["this month"]) == (dt.date(2024, 5, 1), dt.date(2024, 5, 31))
    assert tuple(got["next week"]) == (dt.date(2024, 5, 20), dt.date(2024, 5, 26))
    assert got["May"] is None and got["words"] == "20 May to 26 May 2024" and got["other"] == "May"


def test_latest_fresh(spark):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [("a", t, 1), ("a", t - dt.timedelta(minutes=5), 2), ("b", t - dt.timedelta(minutes=31), 3), ("c", t - dt.timedelta(minutes=30), 4)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v int")
    got = wp.latest_fresh(df, ["k"], "ts", F.lit(t)).select("k", "v")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("c", 4)]


def test_pages(spark):
    html = (
        '<div class="fontDisplayLarge">4,5</div><span class="fontBodyMedium">about</span><button class="a fontBodyMedium">(1,247)</button>'
        '<div class="jftiEf x"><div class="d4r55">Ann</div><span aria-label="5 stars"></span><span class="rsqaWe">a week ago</span>'
        '<span class="wiI7pd">A <b>great</b> stay &amp; more</span></div><div class="jftiEf"><span class="wiI7pd">short</span></div>'
    )
    df = spark.createDataFrame([(1, "https://x/@51.5204,-0.0987,17z/", html), (2, "https://x/", "<p>nothing</p>")], "page_id int, url string, html string")
    assert [tuple(r) for r in pg.businesses(df).orderBy("page_id").collect()] == [(1, 4.5, 1247, 51.5204, -0.0987), (2, None, 0, None, None)]
    assert [tuple(r) for r in pg.page_reviews(df).collect()] == [(1, 0, "A great stay & more", 5, "a week ago", "Ann")]
    assert pg.page_reviews(df, max_reviews=1).count() == 1


def test_entities(spark):
    df = spark.createDataFrame([("Compare abb_12 with BKG_7 on WiFi and price in New York",), ("hello",)], "text string")
    first, second = cv.extract_entities(df).collect()
    assert first["hotels"] == ["ABB_12", "BKG_7"] and first["metrics"] == ["price", "wifi"]
    assert first["locations"] == ["New York"] and first["topics"] == ["competitor_analysis"] and first["competitors"] == []
    assert second["hotels"] == [] and second["topics"] == []


def test_context(spark):
    rows = [("c", i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(["wifi in Rome", "x", "parking wifi", "y" * 400, "pool", "bye"])]
    df = spark.createDataFrame(rows + [("d", 0, "user", "hello")], "conv_id string, turn int, role string, text string")
    summaries = spark.createDataFrame([("c", "User asked about hotel.")], "conv_id string, summary string")
    got = {r["conv_id"]: r["context"] for r in cv.conversation_context(df, summaries).collect()}
    assert got["c"] == (
        "[Previous Context]\nUser asked about hotel.\n\n[Key Entities]\nMetrics of interest: wifi, parking, pool\nLocations: Rome\n"
        "\n[Recent Exchange]\nUSER: pool\nASSISTANT: bye"
    )
    assert got["d"] == "\n[Recent Exchange]\nUSER: hello"
    assert {r["turn"] for r in cv.recent_turns(df.filter("conv_id = 'c'")).collect()} == {2, 3, 4, 5}
    assert {r["turn"] for r in cv.older_turns(df).collect()} == {0, 1}
    cut = cv.exchange(df.filter("turn <= 3 and conv_id = 'c'")).first()["exchange"]
    assert cut.endswith("ASSISTANT: " + "y" * 300 + "...")


@pytest.mark.parametrize(
    "raw, agents",
    [
        ("market_intel, review_analyst", ["market_intel", "review_analyst"]),
        ("Use the benchmark_agent, then MARKET_INTEL or benchmark_agent", ["benchmark_agent", "market_intel"]),
        ("no idea", ["review_analyst"]),
    ],
)
def test_routing(spark, raw, agents):
    assert spark.range(1).select(cv.agent_names(F.lit(raw))).first()[0] == agents


def test_chart_lines(spark):
    text = "intro\n 📊 [A](http://x) \n📊 none\nhttp://y"
    assert spark.range(1).select(cv.chart_lines(F.lit(text))).first()[0] == ["📊 [A](http://x)"]


def test_tool_calls(spark):
    tools = ["search_airbnb_reviews", "search_booking_reviews", "analyze_sentiment_topics"]
    logs = [
        '<function=search_airbnb_reviews {"query": "wifi", "k": 10}\'',
        '<function=search_booking_reviews {"query": "breakfast", "k": "5", "s": "1.5", "f": "True", "n": null}</function>',
        '<function=analyze_sentiment_topics {"topics": ["wifi", "noise"]}',
        '<function=unknown {"a": 1}</function><function=search_booking_reviews>{"k": 2}</function>',
        "<function=search_booking_reviews {broken}</function>",
    ]
    df = spark.createDataFrame(list(enumerate(logs)), "message_id int, text string")
    calls = tl.tool_calls(df, tools)
    assert [(r["message_id"], r["tool"]) for r in calls.orderBy("message_id").collect()] == [
        (0, tools[0]), (1, tools[1]), (2, tools[2]), (3, tools[1])
    ]
    args = {(r["message_id"], r["name"]): (r["arg_type"], r["int_value"], r["float_value"], r["bool_value"], r["text_value"]) for r in tl.typed_arguments(calls).collect()}
    assert args[(0, "query")] == ("text", None, None, None, "wifi") and args[(0, "k")] == ("int", 10, None, None, None)
    assert args[(1, "k")] == ("int", 5, None, None, None) and args[(1, "s")] == ("float", None, 1.5, None, None)
    assert args[(1, "f")] == ("bool", None, None, True, None)
    assert args[(2, "topics")] == ("json", None, None, None, '["wifi","noise"]')


def test_groundedness(spark):
    rows = [
        ("Guests said it is great.", ["nothing of the kind"]),
        ('They wrote "the room was very clean" here. Rating: 4.5', ["review: The room was very clean, rating 4.5"]),
        ('They wrote "purple elephants dance" here. Price: 99', ["x"]),
        ("No information found.", ["no results"]),
        ("Many guests mention the wifi was slow", ["many guests mention the wifi was slow"]),
    ]
    df = spark.createDataFrame(rows, "response string, outputs array<string>")
    got = [(r["risk"], r["is_valid"], r["blocked"]) for r in gr.score_responses(df, strict=True).collect()]
    assert got[0] == (0.15, True, False)
    assert got[1] == (0.0, True, False)
    # one grounded phrase (a quote) cannot push an empty score below zero: 0.2 + 0.1
    assert got[2] == (0.3, False, False)
    assert got[3] == (0.0, True, False) and got[4] == (0.0, True, False)
    loose = gr.score_responses(df).collect()
    assert loose[2]["is_valid"] and not loose[2]["blocked"]


def test_scenarios(spark):
    rows = [
        ("review_analyst", "x, review_analyst", "a" * 60, 2.0), ("a,b", "c", "Unknown tool " + "a" * 60, 4.0), ("a", "a", "short", None), ("a", None, None, None),
    ]
    df = spark.createDataFrame(rows, "expected_agent string, agent_used string, response string, elapsed_seconds double")
    scored = ev.score_scenarios(df)
    assert [(r["routing_correct"], r["success"]) for r in scored.collect()] == [(True, True), (False, False), (True, False), (False, False)]
    summary = ev.scenario_summary(scored).first()
    assert (summary["successful"], summary["routing_correct"], summary["avg_response_time"]) == (1, 2, 1.5)


def test_feedback(spark):
    rows = [(1, 5, 0, None, 3, 4, True, 2.0, "ok"), (1, 3, 4, None, 0, 4, None, 0.0, ""), (1, None, None, None, 3, 1, False, 4.0, None)]
    df = spark.createDataFrame(
        rows, "session_id int, relevance_rating int, accuracy_rating int, actionability_rating int, speed_rating int, overall_rating int, "
        "would_use_again boolean, elapsed_seconds double, comments string",
    ).withColumn("timestamp", F.current_timestamp())
    means = {r["dimension"]: (r["mean_rating"], r["n"]) for r in ev.rating_means(df).collect()}
    assert means == {"relevance": (4.0, 2), "accuracy": (4.0, 1), "actionability": (None, 0), "speed": (3.0, 2), "overall": (3.0, 3)}
    metrics = ev.session_metrics(df).first()
    assert (metrics["would_use_again_share"], metrics["avg_time"], metrics["min_time"], metrics["max_time"]) == (0.5, 3.0, 2.0, 4.0)
    assert ev.comments(df).count() == 1 and ev.session_report(df).count() == 9


def test_topics_of_terms_and_queries(spark):
    df = spark.createDataFrame([("Check-In ",), ("transport",), ("zzz",)], "term string")
    assert [r["matched_topic"] for r in tp.resolve_topic(df).collect()] == ["check-in and check-out process", "public transportation access", "zzz"]
    queries = tp.query_keywords(spark.createDataFrame([("noisy rooms?",), ("hello",)], "query string"))
    first, second = [r["keywords"] for r in queries.collect()]
    assert {"noise", "quiet", "loud", "room", "bed", "noisy", "rooms?"} <= set(first) and second == ["hello"]
    hits = spark.createDataFrame([("A LOUD street", ["loud"]), ("calm", ["loud"])], "t string, k array<string>")
    assert [r[0] for r in hits.select(tp.mentions_keyword(F.col("t"), F.col("k"))).collect()] == [True, False]


def test_elements_end_at_their_own_tag(spark):
    deep = "x" * 50_000 + "<div>" * 500 + "</div>" * 500 + "y"
    cases = [
        ("div", "a<div>b<div>c</div></div>d</div>e</div>", "a<div>b<div>c</div></div>d"),
        ("span", "a<SPAN>b</Span>c</span>d", "a<SPAN>b</Span>c"), ("span", "a<span/>b</span>c", "a<span/>b"),
        ("p", "left open <p>x</p> to the end", "left open <p>x</p> to the end"), ("li", "</li>x", ""), ("b", "<br>x<bold></b>y", "<br>x<bold>"),
        ("div", "", ""), ("", "x</div>", ""), ("div", deep + "</div>z", deep),
    ]
    df = spark.createDataFrame([(i, n, h) for i, (n, h, _) in enumerate(cases)], "i int, n string, h string")
    got = {r["i"]: r["x"] for r in df.select("i", pg.element_inside(F.col("n"), F.col("h")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_nested_review_elements(spark):
    card = (
        '<div class="jftiEf"><div class="d4r55"><div><b>Ann</b></div> Lee</div><span aria-label="3 stars"></span>'
        '<span class="rsqaWe"><span>2</span> days ago</span><span class="wiI7pd">A <span>very <span>quiet</span></span> room</span><span>Like</span></div>'
    )
    html = '<span class="fontBodyMedium"><span class="fontBodyMedium">none</span> and <i>1,204</i></span>' + card
    df = spark.createDataFrame([(1, "u", html), (2, "u", "")], "page_id int, url string, html string")
    assert [tuple(r) for r in pg.page_reviews(df).collect()] == [(1, 0, "A very quiet room", 3, "2 days ago", "Ann Lee")]
    assert {r["page_id"]: r["review_count"] for r in pg.businesses(df).collect()} == {1: 1204, 2: 0}
