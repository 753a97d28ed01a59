"""Normalising landed search, event, weather and map payloads (raw JSON text columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import (
    EVENT_DATE_PATTERN,
    EVENT_SKIP_PHRASES,
    FRESH_MINUTES,
    RAW_SNIPPET_WORDS,
    WEB_QUERY_KEYWORDS,
)
from innsight.functions import text as tx

_HIT = "array<struct<title:string,description:string,snippet:string,link:string,url:string>>"
_EVENT = "array<struct<title:string,description:string,venue:string,date:string>>"
_LOCAL = (
    "array<struct<title:string,name:string,rating:string,reviews:string,review_count:string,address:string>>"
)
_WEATHER = (
    "temperature string, temp string, subtitles array<string>, description string, conditions string, "
    "humidity string, wind string, additional_info array<struct<type:string,text:string>>, "
    "daily_forecast array<struct<day:string,temperature:struct<daytime:string,nighttime:string>>>"
)


def _field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def unwrap(payload: Column) -> Column:
    """The payload itself, or what its ``body`` holds, as an object or as JSON text."""
    return F.coalesce(_field(payload, "body"), payload)


def _is_object(payload: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT")


def _hits(json: Column, prefer: tuple[str, str]) -> Column:
    first, second = prefer
    return F.transform(
        F.from_json(json, _HIT),
        lambda r: F.struct(
            F.coalesce(r["title"], F.lit("")).alias("title"),
            F.substring(F.coalesce(r[first], r[second], F.lit("")), 1, 300).alias("snippet"),
            F.coalesce(r["link"], r["url"], F.lit("")).alias("link"),
        ),
    )


def _raw_hits(raw: Column, limit: int) -> Column:
    """Sentences of a raw text that hold a review word after their first letter, cut to hits."""
    parts = F.regexp_extract_all(raw, F.lit("([^.!?]*[.!?])"), F.lit(1))
    spoken = F.transform(parts, lambda p: F.regexp_extract(p, "(?s)([A-Za-z].*)", 1))
    words = "(?i)" + "|".join(RAW_SNIPPET_WORDS)
    found = F.slice(F.filter(spoken, lambda s: F.rlike(F.substr(s, F.lit(2)), F.lit(words))), 1, limit)
    numbered = F.transform(
        found,
        lambda s, i: F.struct(
            F.concat(F.lit("Result "), (i + 1).cast("string")).alias("title"),
            F.substring(s, 1, 300).alias("snippet"),
            F.lit("").alias("link"),
            F.length(s).alias("chars"),
        ),
    )
    return F.transform(
        F.filter(numbered, lambda r: r["chars"] > 30),
        lambda r: F.struct(r["title"].alias("title"), r["snippet"].alias("snippet"), r["link"].alias("link")),
    )


def search_results(payloads: DataFrame, payload_col: str = "payload", limit: int = 10,
                   keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """One row per search hit: ``(request_id, pos, title, snippet, link)``.

    Organic hits, else the ``results`` list, else sentences of the raw text that look like
    review snippets.
    """
    data = payloads.select(*keep, unwrap(F.col(payload_col)).alias("data"))
    content = F.col("data")
    is_json = F.coalesce(_is_object(content), F.lit(False))
    organic, results, raw = _field(content, "organic"), _field(content, "results"), _field(content, "raw")
    hits = (
        F.when(~is_json, _raw_hits(content, limit))
        .when(organic.isNotNull(), F.slice(_hits(organic, ("description", "snippet")), 1, limit))
        .when(results.isNotNull(), F.slice(_hits(results, ("snippet", "description")), 1, limit))
        .otherwise(_raw_hits(raw, limit))
    )
    return data.select(*keep, F.posexplode(hits).alias("pos", "hit")).select(
        *keep, "pos", "hit.title", "hit.snippet", "hit.link"
    )


def rank_by_keywords(results: DataFrame, keywords: Sequence[str], keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Order hits by the number of keywords in title and snippet, keeping the old order in ties."""
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    scored = results.withColumn("relevance", tx.count_found(text, [w.lower() for w in keywords]))
    window = Window.partitionBy(*keys).orderBy(F.desc("relevance"), "pos")
    return scored.withColumn("position", F.row_number().over(window))


def web_query_words(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Append ``topic_words``, the known words of a query, and ``topic_text``, ``review`` without any."""
    words = tx.words_found(F.lower(F.col(query_col)), WEB_QUERY_KEYWORDS)
    return queries.withColumn("topic_words", words).withColumn(
        "topic_text",
        F.when(F.size("topic_words") > 0, F.array_join("topic_words", " ")).otherwise("review"),
    )


def unique_links(results: DataFrame, topic_words: Sequence[str], keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """First hit of every link per request, hits on the topic before the others."""
    first = Window.partitionBy(*keys, "link").orderBy("pos")
    unique = results.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")
    marked = unique.withColumn("has_topic", tx.contains_any(F.lower("snippet"), topic_words))
    order = Window.partitionBy(*keys).orderBy(F.desc("has_topic"), "pos")
    return marked.withColumn("position", F.row_number().over(order))


def events(payloads: DataFrame, payload_col: str = "payload", limit: int = 10,
           keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """Events of a payload: the event widget and the organic hits, each name once.

    ``(request_id, pos, name, description, date, link)``. Lists are short, so names are
    compared within the payload's own list; nothing is shuffled.
    """
    data = payloads.select(*keep, unwrap(F.col(payload_col)).alias("data"))
    nothing = F.lit("No description available")
    widget = F.transform(
        F.slice(F.from_json(_field(F.col("data"), "events"), _EVENT), 1, limit),
        lambda e: F.struct(
            F.coalesce(e["title"], F.lit("Unknown Event")).alias("name"),
            F.coalesce(e["description"], e["venue"], nothing).alias("description"),
            F.coalesce(e["date"], F.lit("Date not specified")).alias("date"),
            F.lit(None).cast("string").alias("link"),
        ),
    )

    def organic_event(hit: Column) -> Column:
        title = tx.strip(F.coalesce(hit["title"], F.lit("")))
        snippet = tx.strip(F.coalesce(hit["description"], hit["snippet"], F.lit("")))
        date = F.regexp_extract(F.concat_ws(" ", title, snippet), f"({EVENT_DATE_PATTERN})", 1)
        return F.struct(
            title.alias("name"),
            F.when(snippet != "", F.substring(snippet, 1, 300)).otherwise(nothing).alias("description"),
            F.coalesce(F.nullif(date, F.lit("")), F.lit("See link for dates")).alias("date"),
            F.coalesce(hit["link"], F.lit("")).alias("link"),
        )

    organic = F.filter(
        F.transform(F.slice(F.from_json(_field(F.col("data"), "organic"), _HIT), 1, limit), organic_event),
        lambda e: (e["name"] != "") & ~tx.contains_any(F.lower(e["name"]), EVENT_SKIP_PHRASES),
    )
    none = F.array().cast("array<struct<name:string,description:string,date:string,link:string>>")
    both = F.concat(F.coalesce(widget, none), F.coalesce(organic, none))
    found = data.select(*keep, F.when(_field(F.col("data"), "error").isNull(), both).alias("found"))
    keyed = found.withColumn(
        "keys", F.transform("found", lambda e: F.substring(F.lower(e["name"]), 1, 60))
    )
    first = F.transform(
        "found", lambda e, i: F.when(F.array_position(F.col("keys"), F.get(F.col("keys"), i)) == i + 1, e)
    )
    return (
        keyed.select(*keep, F.posexplode(first).alias("pos", "e"))
        .filter(F.col("e").isNotNull())
        .select(*keep, "pos", "e.*")
    )


def date_range(phrase: Column, today: Column) -> Column:
    """First and last day a relative phrase stands for: this week, this month or next week.

    Other phrases give nulls.
    """
    text = F.lower(phrase)
    monday = F.to_date(F.date_trunc("week", today))
    return (
        F.when(text.contains("this week"), F.struct(monday.alias("first"), F.date_add(monday, 6).alias("last")))
        .when(
            text.contains("this month"),
            F.struct(F.trunc(today, "month").alias("first"), F.last_day(today).alias("last")),
        )
        .when(
            text.contains("next week"),
            F.struct(F.date_add(monday, 7).alias("first"), F.date_add(monday, 13).alias("last")),
        )
    )


def date_phrase(phrase: Column, today: Column) -> Column:
    """The wording used to search for the range: days for weeks, the month's name for months."""
    span = date_range(phrase, today)
    text = F.lower(phrase)
    days = F.concat(
        F.date_format(span["first"], "dd MMMM"), F.lit(" to "), F.date_format(span["last"], "dd MMMM yyyy")
    )
    return (
        F.when(span.isNull(), phrase)
        .when(text.contains("this month") & ~text.contains("this week"), F.date_format(span["first"], "MMMM yyyy"))
        .otherwise(days)
    )


def weather(payloads: DataFrame, payload_col: str = "payload", keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """Current weather per payload and where it came from.

    The weather widget, else the answer box, else the knowledge graph, else the first
    organic hits about the weather.
    """
    data = payloads.select(*keep, unwrap(F.col(payload_col)).alias("data")).filter(
        _field(F.col("data"), "error").isNull()
    )
    d = F.col("data")
    parsed = data.withColumn("w", F.from_json(_field(d, "weather"), _WEATHER))
    w = F.col("w")
    conditions = F.when(F.size(w["subtitles"]) > 1, F.get(w["subtitles"], F.lit(1))).otherwise(
        F.coalesce(F.nullif(w["description"], F.lit("")), F.nullif(w["conditions"], F.lit("")))
    )
    infos = F.filter(
        w["additional_info"], lambda i: (F.coalesce(i["type"], F.lit("")) != "") & (F.coalesce(i["text"], F.lit("")) != "")
    )
    from_infos = F.array_join(F.transform(infos, lambda i: F.concat(i["type"], F.lit(": "), i["text"])), "; ")
    older = F.concat_ws(
        "; ",
        F.when(w["humidity"].isNotNull(), F.concat(F.lit("Humidity: "), w["humidity"])),
        F.when(w["wind"].isNotNull(), F.concat(F.lit("Wind: "), w["wind"])),
    )
    details = F.when(F.size(w["additional_info"]) > 0, from_infos).otherwise(older)
    box, graph = _field(d, "answer_box"), _field(d, "knowledge_graph")
    boxed = F.coalesce(F.get_json_object(box, "$.answer"), F.get_json_object(box, "$.snippet"))
    described = F.substring(F.nullif(F.get_json_object(graph, "$.description"), F.lit("")), 1, 300)
    hits = F.transform(
        F.slice(F.from_json(_field(d, "organic"), _HIT), 1, 3),
        lambda h: F.struct(
            F.coalesce(h["title"], F.lit("")).alias("title"),
            F.substring(F.coalesce(h["description"], h["snippet"], F.lit("")), 1, 200).alias("snippet"),
        ),
    )
    about = F.filter(hits, lambda h: F.contains(h["snippet"], F.lit("°")) | F.contains(F.lower(h["title"]), F.lit("weather")))
    listed = F.array_join(F.transform(about, lambda h: F.concat_ws(": ", h["title"], h["snippet"])), "; ")
    fallback = (
        F.when(box.isNotNull(), boxed).when(graph.isNotNull(), described)
    )
    summary = F.when(w.isNull(), F.coalesce(fallback, F.nullif(listed, F.lit(""))))
    origin = (
        F.when(w.isNotNull(), "weather")
        .when(fallback.isNotNull() & box.isNotNull(), "answer_box")
        .when(fallback.isNotNull(), "knowledge_graph")
        .when(F.nullif(listed, F.lit("")).isNotNull(), "organic")
        .otherwise("none")
    )
    return parsed.select(
        *keep, origin.alias("origin"),
        F.when(w.isNotNull(), F.coalesce(w["temperature"], w["temp"], F.lit("N/A"))).alias("temperature"),
        conditions.alias("conditions"), F.when(w.isNotNull(), details).alias("details"),
        summary.alias("summary"),
    )


def forecast(payloads: DataFrame, payload_col: str = "payload", days: int = 3,
             keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """The first ``days`` days of the forecast: ``(request_id, day_no, day, high, low)``."""
    w = F.from_json(_field(unwrap(F.col(payload_col)), "weather"), _WEATHER)
    return payloads.select(*keep, F.posexplode(F.slice(w["daily_forecast"], 1, days)).alias("day_no", "d")).select(
        *keep, "day_no", F.coalesce("d.day", F.lit("")).alias("day"),
        F.coalesce("d.temperature.daytime", F.lit("N/A")).alias("high"),
        F.coalesce("d.temperature.nighttime", F.lit("N/A")).alias("low"),
    )


def local_results(payloads: DataFrame, payload_col: str = "payload", limit: int = 5,
                  keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """Businesses of a map payload: ``(request_id, pos, name, rating, reviews, address)``."""
    d = unwrap(F.col(payload_col))
    items = F.from_json(F.coalesce(_field(d, "results"), _field(d, "local_results")), _LOCAL)
    missing = F.lit("N/A")
    return payloads.select(*keep, F.posexplode(F.slice(items, 1, limit)).alias("pos", "i")).select(
        *keep, "pos", F.coalesce("i.title", "i.name", F.lit("Unknown")).alias("name"),
        F.coalesce("i.rating", missing).alias("rating"),
        F.coalesce("i.reviews", "i.review_count", missing).alias("reviews"),
        F.coalesce("i.address", missing).alias("address"),
    )


def business_panel(payloads: DataFrame, payload_col: str = "payload", keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """Name, rating, address and phone of the knowledge panel, where a payload has one."""
    panel = _field(unwrap(F.col(payload_col)), "knowledge_graph")
    found = payloads.select(*keep, panel.alias("panel")).filter(F.col("panel").isNotNull())
    return found.select(
        *keep,
        *[
            F.coalesce(F.get_json_object("panel", f"$.{f}"), F.lit("N/A")).alias(name)
            for name, f in (("business", "title"), ("rating", "rating"), ("address", "address"), ("phone", "phone"))
        ],
    )


def direct_answer(payloads: DataFrame, payload_col: str = "payload", limit: int = 5,
                  keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """The quick answer of a payload as position 0, then its first organic hits."""
    data = payloads.select(*keep, unwrap(F.col(payload_col)).alias("data")).filter(
        _field(F.col("data"), "error").isNull()
    )
    box = _field(F.col("data"), "answer_box")
    answer = F.coalesce(F.get_json_object(box, "$.answer"), F.get_json_object(box, "$.snippet"), F.lit(""))
    hits = F.transform(
        F.slice(F.from_json(_field(F.col("data"), "organic"), _HIT), 1, limit),
        lambda h, i: F.struct(
            (i + 1).alias("position"),
            F.coalesce(h["title"], F.lit("Unknown")).alias("title"),
            F.substring(F.coalesce(h["description"], h["snippet"], F.lit("")), 1, 200).alias("snippet"),
            F.coalesce(h["link"], F.lit("")).alias("link"),
        ),
    )
    kind = "array<struct<position:int,title:string,snippet:string,link:string>>"
    quick = F.when(
        answer != "",
        F.array(F.struct(F.lit(0).alias("position"), F.lit("Quick Answer").alias("title"),
                         answer.alias("snippet"), F.lit("").alias("link"))),
    )
    none = F.array().cast(kind)
    return data.select(*keep, F.inline(F.concat(F.coalesce(quick.cast(kind), none), F.coalesce(hits.cast(kind), none))))


def latest_fresh(snapshots: DataFrame, keys: Sequence[str], ts_col: str, as_of: Column,
                 minutes: int = FRESH_MINUTES, tie_col: str | None = None) -> DataFrame:
    """The latest snapshot per key, where it is at most ``minutes`` old.

    Old snapshots are filtered before the shuffle: if the latest is too old, all are.
    """
    recent = snapshots.filter((F.col(ts_col) <= as_of) & (F.col(ts_col) >= as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")))
    order = [F.desc(ts_col)] + ([F.desc(tie_col)] if tie_col else [])
    window = Window.partitionBy(*keys).orderBy(*order)
    return recent.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")


def cache_key(query: Column, n: Column) -> Column:
    return F.concat(F.lit("serp::"), F.lower(query), F.lit("::"), n.cast("string"))
