"""Web payloads, stored pages, conversations, logs and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.fixed_values import AGENT_NAMES, COMPETITOR_CUES, METRIC_WORDS, PLACE_WORDS
from innsight.operators import conversations as cv
from innsight.operators import evaluation as ev
from innsight.operators import grounding as gr
from innsight.operators import pages as pg
from innsight.operators import toollogs as tl
from innsight.operators import webpayloads as wp
from innsight.sources import tables
from innsight.sources.shared import shared_folder
from suite import derive as d
from suite.derive import table, with_sql
from suite.registry import query


# --- search payloads ------------------------------------------------------------------------------

@query(with_sql("SELECT request_id, pos, title, snippet, link FROM search_hits", d.SEARCH_HITS_SQL))
def search_results(spark, sf_dir):
    """G1: hits of bare, wrapped, alternative and raw payloads."""
    return wp.search_results(d.search_payloads(spark, sf_dir))


_KEYWORDS = ["the", "und", "De", "que", "hotel"]


@query(with_sql(
    """scored AS (SELECT *, """ + " + ".join(f"CAST(contains(lower(title || ' ' || snippet), '{w.lower()}') AS INTEGER)" for w in _KEYWORDS) + """ AS relevance FROM search_hits)
       SELECT request_id, pos, relevance, CAST(row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, pos) AS INTEGER) AS position FROM scored""",
    d.SEARCH_HITS_SQL))
def keyword_ranked_results(spark, sf_dir):
    """Hits by the number of keywords they hold."""
    ranked = wp.rank_by_keywords(wp.search_results(d.search_payloads(spark, sf_dir)), _KEYWORDS)
    return ranked.select("request_id", "pos", "relevance", "position")


@query(with_sql(
    """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, link ORDER BY pos) AS n FROM search_hits) WHERE n = 1),
       marked AS (SELECT *, contains(lower(snippet), 'the') OR contains(lower(snippet), 'und') AS has_topic FROM firsts)
       SELECT request_id, link, pos, has_topic, CAST(row_number() OVER (PARTITION BY request_id ORDER BY has_topic DESC, pos) AS INTEGER) AS position FROM marked""",
    d.SEARCH_HITS_SQL))
def unique_links(spark, sf_dir):
    """The first hit of every link, hits on the topic first."""
    unique = wp.unique_links(wp.search_results(d.search_payloads(spark, sf_dir)), ["the", "und"])
    return unique.select("request_id", "link", "pos", "has_topic", "position")


@query(with_sql(
    """SELECT request_id, CAST(pos + 1 AS INTEGER) AS position, title,
         substr(CASE WHEN form = 3 THEN NULL ELSE title || ' and ' || advert END, 1, 200) AS snippet, link
       FROM listed_hits WHERE pos < 5 AND form < 3""", d.SEARCH_HITS_SQL))
def direct_answers(spark, sf_dir):
    """Quick answer and first organic hits."""
    return wp.direct_answer(d.search_payloads(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN 'wifi speed' WHEN k % 3 = 1 THEN 'room ac' ELSE '' END AS words,
          CASE WHEN k % 3 = 0 THEN 'wifi speed' WHEN k % 3 = 1 THEN 'room ac' ELSE 'review' END AS topic_text
          FROM (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events)""")
def web_query_words(spark, sf_dir):
    """X6 for web queries: the known words of a query, in list order."""
    k = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(3))
    asked = F.when(k == 0, "Speed of the WiFi?").when(k == 1, "A room with AC").otherwise("How is it?")
    words = wp.web_query_words(table(spark, sf_dir, "events").select("event_id", asked.alias("query")))
    return words.select("event_id", F.array_join("topic_words", " ").alias("words"), "topic_text")


# --- events, weather, places -------------------------------------------------------------------------

@query("""
WITH raw AS (
  SELECT o_orderkey AS request_id, pos, name, description, date, link FROM (
    SELECT o_orderkey, unnest([
      {'pos': 0, 'name': 'Show ' || o_orderstatus, 'description': 'Hall ' || o_custkey,
       'date': CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%b %-d') ELSE 'Date not specified' END, 'link': NULL},
      {'pos': 1, 'name': 'Concert ' || o_orderpriority, 'description': 'Doors open on ' || strftime(o_orderdate, '%a, %b %-d'),
       'date': strftime(o_orderdate, '%a, %b %-d'), 'link': 'http://a'},
      {'pos': 2, 'name': upper('Show ' || o_orderstatus), 'description': 'again', 'date': 'See link for dates', 'link': 'http://c'},
      {'pos': 3, 'name': 'Fair ' || strftime(o_orderdate, '%-d/%-m/%Y'), 'description': 'No description available',
       'date': strftime(o_orderdate, '%-d/%-m/%Y'), 'link': 'http://d'},
      {'pos': 4, 'name': 'Parade in march', 'description': 'free', 'date': 'march', 'link': 'http://e'},
      {'pos': 5, 'name': 'Open house', 'description': 'free', 'date': 'See link for dates', 'link': 'http://f'}], recursive := true)
    FROM orders))
SELECT request_id, CAST(pos AS INTEGER) AS pos, name, description, date, link FROM raw WHERE pos <> 2
""")
def event_listings(spark, sf_dir):
    """Events of the widget and the organic hits, dates found in the text, names once."""
    return wp.events(d.event_payloads(spark, sf_dir))


@query("""
WITH asked AS (SELECT event_id, CAST(ts AS DATE) AS today, CASE event_type WHEN 'view' THEN 'This week' WHEN 'click' THEN 'this month'
    WHEN 'signup' THEN 'events next week' ELSE 'May 2024' END AS phrase FROM events),
spans AS (SELECT *, CAST(date_trunc('week', today) AS DATE) AS monday, CAST(date_trunc('month', today) AS DATE) AS month FROM asked)
SELECT event_id, phrase,
  CAST(CASE phrase WHEN 'This week' THEN monday WHEN 'this month' THEN month WHEN 'events next week' THEN CAST(monday + 7 AS DATE) END AS VARCHAR) AS first,
  CAST(CASE phrase WHEN 'This week' THEN CAST(monday + 6 AS DATE) WHEN 'this month' THEN last_day(today) WHEN 'events next week' THEN CAST(monday + 13 AS DATE) END AS VARCHAR) AS last,
  CASE phrase WHEN 'This week' THEN strftime(monday, '%d %B') || ' to ' || strftime(monday + 6, '%d %B %Y')
    WHEN 'this month' THEN strftime(month, '%B %Y')
    WHEN 'events next week' THEN strftime(monday + 7, '%d %B') || ' to ' || strftime(monday + 13, '%d %B %Y') ELSE phrase END AS wording
FROM spans
""")
def date_ranges(spark, sf_dir):
    """The relative phrase of every event to its date range and wording."""
    kind = F.col("event_type")
    phrase = (
        F.when(kind == "view", "This week").when(kind == "click", "this month")
        .when(kind == "signup", "events next week").otherwise("May 2024")
    )
    asked = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("today"), phrase.alias("phrase"))
    span = wp.date_range(F.col("phrase"), F.col("today"))
    return asked.select(
        "event_id", "phrase", span["first"].cast("string").alias("first"), span["last"].cast("string").alias("last"),
        wp.date_phrase(F.col("phrase"), F.col("today")).alias("wording"),
    )


@query("""
WITH e AS (SELECT event_id AS request_id, event_type, CAST(value AS VARCHAR) AS v, props->>'$.k' AS k FROM events)
SELECT request_id, CASE event_type WHEN 'view' THEN 'weather' WHEN 'click' THEN 'weather' WHEN 'signup' THEN 'answer_box'
    WHEN 'purchase' THEN 'knowledge_graph' ELSE 'organic' END AS origin,
  CASE WHEN event_type IN ('view', 'click') THEN v END AS temperature,
  CASE event_type WHEN 'view' THEN 'Cloudy ' || k WHEN 'click' THEN 'Sunny' END AS conditions,
  CASE event_type WHEN 'view' THEN 'Humidity: ' || k || '%' WHEN 'click' THEN 'Humidity: ' || k || '; Wind: 5 km/h' END AS details,
  CASE event_type WHEN 'signup' THEN 'It is ' || k WHEN 'purchase' THEN 'A city with ' || k
    WHEN 'error' THEN 'Weather today: about ' || k || '; Forecast: ' || v || '°C' END AS summary
FROM e
""")
def weather_reports(spark, sf_dir):
    """Weather from the widget, the answer box, the knowledge graph or organic hits."""
    return wp.weather(d.weather_payloads(spark, sf_dir))


@query("""
SELECT event_id AS request_id, CAST(i - 1 AS INTEGER) AS day_no, 'Day ' || i AS day, (props->>'$.k') || '.' || i AS high,
  CASE WHEN i = 2 THEN 'N/A' ELSE props->>'$.k' END AS low
FROM events, (SELECT unnest([1, 2, 3]) AS i) WHERE event_type = 'view'
""")
def weather_forecast(spark, sf_dir):
    """Three days of the forecast."""
    return wp.forecast(d.weather_payloads(spark, sf_dir))


@query("""
SELECT p_partkey AS request_id, CAST(i - 1 AS INTEGER) AS pos, p_name || ' ' || i AS name, i || '.5' AS rating,
  CASE WHEN i = 3 THEN 'N/A' ELSE CAST(i * 10 AS VARCHAR) END AS reviews, p_brand AS address
FROM part, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE p_type <> 'PROMO' AND i <= p_size % 8 + 1
""")
def local_results(spark, sf_dir):
    """The first five businesses of a map payload."""
    return wp.local_results(d.map_payloads(spark, sf_dir))


@query("""SELECT p_partkey AS request_id, p_name AS business, 'N/A' AS rating, p_brand AS address, 'N/A' AS phone FROM part WHERE p_type = 'PROMO'""")
def business_panels(spark, sf_dir):
    """The knowledge panel of a payload."""
    return wp.business_panel(d.map_payloads(spark, sf_dir))


@query("""SELECT user_id, event_type, event_id, 'serp::' || lower('Hotel ' || upper(event_type)) || '::' || user_id AS cache_key FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events
          WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 MINUTES * 48 AND ts <= TIMESTAMP '2024-01-15 12:00:00') WHERE n = 1""")
def latest_fresh(spark, sf_dir):
    """The latest snapshot per key that is not too old, a day in this log."""
    fresh = wp.latest_fresh(
        table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts",
        F.lit("2024-01-15 12:00:00").cast(dict(table(spark, sf_dir, "events").dtypes)["ts"]), minutes=30 * 48, tie_col="event_id",
    )
    key = wp.cache_key(F.concat(F.lit("Hotel "), F.upper("event_type")), F.col("user_id"))
    return fresh.select("user_id", "event_type", "event_id", key.alias("cache_key"))


# --- stored pages ----------------------------------------------------------------------------------------

@query("""SELECT page_id, page_id % 5 + 0.5::DOUBLE AS rating, length(html) AS review_count,
          CAST(page_id % 90 || '.5204' AS DOUBLE) AS lat, CAST('-0.' || page_id AS DOUBLE) AS lng FROM pages""")
def map_businesses(spark, sf_dir):
    """Rating, review count and coordinates of stored map pages."""
    return pg.businesses(d.map_pages(spark, sf_dir))


@query(r"""
WITH paragraphs AS (SELECT page_id, unnest(l) AS p, unnest(range(len(l))) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS l FROM pages)),
-- what follows the opening tag of the text, as tags and texts with the depth of spans
tokens AS (SELECT page_id, i, unnest(t) AS token, unnest(range(len(t))) AS k FROM (
  SELECT page_id, i, regexp_extract_all('<span>' || p || '</span><SPAN/><span class="more"> (<span>more</span>)</span></span><span>Like</span></div>',
    '(?s)<[^>]*>|[^<]+|<') AS t FROM paragraphs)),
depths AS (SELECT *, sum(CASE WHEN regexp_matches(token, '(?i)^</span\b') THEN -1 WHEN regexp_matches(token, '(?i)^<span\b') AND NOT ends_with(token, '/>') THEN 1 ELSE 0 END)
  OVER (PARTITION BY page_id, i ORDER BY k) AS depth FROM tokens),
inside AS (SELECT d.page_id, d.i, string_agg(token, '' ORDER BY k) AS p FROM depths d
  JOIN (SELECT page_id, i, min(k) FILTER (depth < 0) AS stop FROM depths GROUP BY page_id, i) e ON e.page_id = d.page_id AND e.i = d.i AND k < stop
  GROUP BY d.page_id, d.i),
cleaned AS (SELECT page_id, i, trim(replace(replace(replace(replace(replace(regexp_replace(p, '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS review_text FROM inside)
SELECT page_id, CAST(i AS INTEGER) AS pos, review_text, CAST(i % 5 + 1 AS INTEGER) AS rating, i || ' days ago' AS review_date,
  'Reader ' || i AS reviewer_name FROM cleaned WHERE length(review_text) > 10
""")
def map_reviews(spark, sf_dir):
    """All review blocks of stored map pages."""
    return pg.page_reviews(d.map_pages(spark, sf_dir))


@query(r"""
WITH RECURSIVE tokens AS (SELECT page_id, regexp_extract_all(html, '(?s)<[^>]*>|[^<]+|<') AS t FROM pages),
starts AS (SELECT page_id, t, list_position(t, '<ul>') AS k FROM tokens WHERE list_contains(t, '<ul>')),
walk AS (
  SELECT page_id, t, k + 1 AS k, 0 AS depth, '' AS text FROM starts
  UNION ALL
  SELECT page_id, t, k + 1, depth + CASE WHEN regexp_matches(t[k], '^</li\b') THEN -1 WHEN regexp_matches(t[k], '^<li\b') THEN 1 ELSE 0 END,
    text || CASE WHEN depth > 0 AND t[k][1] <> '<' THEN t[k] ELSE '' END || CASE WHEN regexp_matches(t[k], '^</li\b') AND depth = 1 THEN '|' ELSE '' END
  FROM walk WHERE k <= len(t) AND NOT regexp_matches(t[k], '^</ul\b'))
SELECT page_id, text AS entries FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k DESC) AS n FROM walk) WHERE n = 1
""")
def navigation_entries(spark, sf_dir):
    """The entries of every page's first list, by balanced elements within an element."""
    pages = d.costly(spark, sf_dir, "pages")
    listed = pages.where(F.contains("html", F.lit("<ul>"))).select(
        "page_id", pg.element_inside(F.lit("ul"), F.regexp_extract("html", "(?s)<ul>(.*)$", 1)).alias("held")
    )
    entries = F.transform(
        F.filter(F.split("held", "(?=<li>)"), lambda p: p.startswith("<li>")),
        lambda p: F.concat(F.regexp_replace(pg.element_inside(F.lit("li"), F.substr(p, F.lit(5))), "<[^>]*>", ""), F.lit("|")),
    )
    return listed.select("page_id", F.array_join(entries, "").alias("entries"))


# --- conversations ----------------------------------------------------------------------------------------

_ENTITY_SQL = f"""
entities AS (
  SELECT conv_id, turn, list_transform(regexp_extract_all(text, '(?i)(BKG_\\d+|ABB_\\d+)', 1), lambda h: upper(h)) AS hotels,
    list_filter({METRIC_WORDS!r}, lambda w: contains(lower(text), w)) AS metrics,
    list_transform(list_filter({PLACE_WORDS!r}, lambda w: contains(lower(text), w)),
      lambda p: array_to_string(list_transform(string_split(p, ' '), lambda x: upper(x[1]) || x[2:]), ' ')) AS locations,
    CASE WHEN {' OR '.join(f"contains(lower(text), '{c}')" for c in COMPETITOR_CUES)} THEN ['competitor_analysis'] ELSE [] END AS topics
  FROM messages),
mentions AS (
  SELECT conv_id, turn, 'hotels' AS kind, unnest(hotels) AS entity, unnest(range(len(hotels))) AS pos FROM entities UNION ALL
  SELECT conv_id, turn, 'metrics', unnest(metrics), unnest(range(len(metrics))) FROM entities UNION ALL
  SELECT conv_id, turn, 'locations', unnest(locations), unnest(range(len(locations))) FROM entities UNION ALL
  SELECT conv_id, turn, 'topics', unnest(topics), unnest(range(len(topics))) FROM entities),
seen AS (SELECT conv_id, kind, entity, min(turn * 1000000 + pos) AS seen, min(turn) AS first_turn FROM mentions GROUP BY ALL),
state AS (SELECT conv_id, kind, entity, first_turn,
  CAST(row_number() OVER (PARTITION BY conv_id, kind ORDER BY seen, entity) AS INTEGER) AS position FROM seen),
entity_lines AS (SELECT conv_id, kind, string_agg(entity, ', ' ORDER BY position) AS names FROM state GROUP BY ALL),
entity_context AS (SELECT conv_id, string_agg(CASE kind WHEN 'hotels' THEN 'Hotels discussed: ' WHEN 'metrics' THEN 'Metrics of interest: '
    WHEN 'locations' THEN 'Locations: ' ELSE 'Topics: ' END || names, chr(10)
    ORDER BY CASE kind WHEN 'hotels' THEN 1 WHEN 'metrics' THEN 2 WHEN 'locations' THEN 3 ELSE 4 END) AS entity_context
  FROM entity_lines GROUP BY conv_id)
"""


@query(with_sql(
    """SELECT conv_id, turn, array_to_string(hotels, '|') AS hotels, array_to_string(metrics, '|') AS metrics,
       array_to_string(locations, '|') AS locations, array_to_string(topics, '|') AS topics FROM entities""", d.MESSAGES_SQL, _ENTITY_SQL))
def entity_extract(spark, sf_dir):
    """Hotels, metrics, places and topics of every message."""
    found = cv.extract_entities(d.messages(spark, sf_dir))
    return found.select("conv_id", "turn", *[F.array_join(c, "|").alias(c) for c in ("hotels", "metrics", "locations", "topics")])


@query(with_sql("SELECT conv_id, kind, entity, first_turn, position FROM state", d.MESSAGES_SQL, _ENTITY_SQL))
def entity_state(spark, sf_dir):
    """Entities of each conversation in first-seen order."""
    return cv.entity_state(d.messages(spark, sf_dir))


@query(with_sql("SELECT conv_id, entity_context FROM entity_context", d.MESSAGES_SQL, _ENTITY_SQL))
def entity_contexts(spark, sf_dir):
    """The entities of each conversation as text."""
    return cv.entity_context(cv.entity_state(d.messages(spark, sf_dir)))


@query(with_sql(
    """joined AS (SELECT a.conv_id, a.turn, list_concat(a.hotels, b.hotels) AS hotels, list_concat(a.metrics, b.metrics) AS metrics
         FROM entities a JOIN entities b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)
       SELECT conv_id, turn,
         array_to_string(list_filter(hotels, lambda x, i: list_position(hotels, x) = i), '|') AS hotels,
         array_to_string(list_filter(metrics, lambda x, i: list_position(metrics, x) = i), '|') AS metrics FROM joined""", d.MESSAGES_SQL, _ENTITY_SQL))
def merged_entities(spark, sf_dir):
    """Entity lists of consecutive turns merged without repeats."""
    found = cv.extract_entities(d.messages(spark, sf_dir))
    kinds = F.struct("hotels", "metrics", "competitors", "locations", "topics")
    left = found.select("conv_id", "turn", kinds.alias("old"))
    right = found.select("conv_id", (F.col("turn") - 1).alias("turn"), kinds.alias("new"))
    merged = cv.merge_entities(left.join(right, ["conv_id", "turn"]), "old", "new", "merged")
    return merged.select(
        "conv_id", "turn", F.array_join("merged.hotels", "|").alias("hotels"), F.array_join("merged.metrics", "|").alias("metrics")
    )


@query("""SELECT conv_id, turn, role, text, back FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back
          FROM conversations) WHERE back <= 4""")
def recent_turns(spark, sf_dir):
    """The last four turns of each conversation."""
    return cv.recent_turns(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
          FROM conversations) WHERE back > 4""")
def older_turns(spark, sf_dir):
    """The turns a summary has to cover."""
    return cv.older_turns(table(spark, sf_dir, "conversations"))


_CONTEXT_SQL = r"""
exchange AS (SELECT conv_id, string_agg(upper(role) || ': ' || CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END,
    chr(10) ORDER BY turn) AS exchange
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM messages) WHERE back <= 2 GROUP BY conv_id)
"""


@query(with_sql("SELECT conv_id, exchange FROM exchange", d.MESSAGES_SQL, _CONTEXT_SQL))
def exchanges(spark, sf_dir):
    """The last two turns as text, each cut to 300 characters."""
    return cv.exchange(d.messages(spark, sf_dir))


@query(with_sql(
    """SELECT x.conv_id, concat_ws(chr(10), CASE WHEN s.summary IS NOT NULL THEN '[Previous Context]' || chr(10) || s.summary END,
         CASE WHEN entity_context IS NOT NULL THEN chr(10) || '[Key Entities]' || chr(10) || entity_context END,
         chr(10) || '[Recent Exchange]' || chr(10) || exchange) AS context
       FROM exchange x LEFT JOIN entity_context e ON x.conv_id = e.conv_id
       LEFT JOIN (SELECT conv_id, min(text) AS summary FROM conversations WHERE role = 'system' GROUP BY conv_id) s ON x.conv_id = s.conv_id""",
    d.MESSAGES_SQL, _ENTITY_SQL, _CONTEXT_SQL))
def context_strings(spark, sf_dir):
    """H1: the context of each conversation: summary, entities and last exchange."""
    summaries = (
        table(spark, sf_dir, "conversations").filter(F.col("role") == "system")
        .groupBy("conv_id").agg(F.min("text").alias("summary"))
    )
    return cv.conversation_context(d.messages(spark, sf_dir), summaries)


# --- routing and logs -----------------------------------------------------------------------------------------

def _routing_text(turn, text):
    return (
        F.when(turn == 0, F.lit("Market_Intel, review_analyst\n nobody"))
        .when(turn == 1, F.concat(F.lit("I would use the Benchmark_Agent after market_intel: "), text))
        .when(turn == 2, F.lit("competitor_analyst"))
        .otherwise(text)
    )


@query("""SELECT conv_id, turn, CASE turn WHEN 0 THEN 'market_intel|review_analyst' WHEN 1 THEN 'benchmark_agent|market_intel'
          WHEN 2 THEN 'competitor_analyst' ELSE 'review_analyst' END AS agents FROM conversations""")
def routed_agents(spark, sf_dir):
    """H2: agents named in routing answers, with the fallback."""
    c = table(spark, sf_dir, "conversations")
    named = cv.agent_names(_routing_text(F.col("turn"), F.col("text")), AGENT_NAMES)
    return c.select("conv_id", "turn", F.array_join(named, "|").alias("agents"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '📊 [Chart ' || turn || '](http://x)' ELSE '' END AS charts FROM conversations""")
def chart_lines(spark, sf_dir):
    """Lines with a chart mark and a link."""
    c = table(spark, sf_dir, "conversations")
    chart = F.concat(F.lit("\n 📊 [Chart "), F.col("turn").cast("string"), F.lit("](http://x) \n📊 no link\nhttp://y\n"))
    text = F.concat("text", F.when(F.pmod("turn", F.lit(2)) == 0, chart).otherwise(""))
    return c.select("conv_id", "turn", F.array_join(cv.chart_lines(text), "|").alias("charts"))


@query(with_sql("SELECT message_id, call_no, tool, args_json FROM tool_calls", d.TOOL_LOGS_SQL))
def tool_calls(spark, sf_dir):
    """H3: calls recovered from logs, known tools and valid arguments only."""
    return tl.tool_calls(d.tool_logs(spark, sf_dir), d.KNOWN_TOOLS)


@query(with_sql(
    r"""args AS (SELECT message_id, call_no, tool, j.key AS name, j.type AS kind, CASE WHEN j.type = 'VARCHAR' THEN json_extract_string(args_json, '$.' || j.key) ELSE CAST(j.value AS VARCHAR) END AS text
         FROM tool_calls, json_each(args_json) j),
       typed AS (SELECT *, CASE WHEN kind = 'VARCHAR' THEN CASE WHEN regexp_full_match(text, '[0-9]+') THEN 'int'
           WHEN regexp_full_match(text, '[0-9]+\.[0-9]*|\.[0-9]+') THEN 'float' WHEN lower(text) IN ('true', 'false') THEN 'bool' ELSE 'text' END
         WHEN kind IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN kind = 'DOUBLE' THEN 'float' WHEN kind = 'BOOLEAN' THEN 'bool' ELSE 'json' END AS arg_type FROM args)
       SELECT message_id, call_no, tool, name, arg_type, CASE WHEN arg_type = 'int' THEN CAST(CAST(text AS BIGINT) AS VARCHAR) END AS int_value,
         CASE WHEN arg_type = 'float' THEN CAST(CAST(text AS DOUBLE) AS VARCHAR) END AS float_value,
         CASE WHEN arg_type = 'bool' THEN CAST(CAST(lower(text) AS BOOLEAN) AS VARCHAR) END AS bool_value,
         CASE WHEN arg_type IN ('text', 'json') THEN replace(text, ', ', ',') END AS text_value FROM typed""", d.TOOL_LOGS_SQL))
def tool_arguments(spark, sf_dir):
    """H4: arguments of the calls in columns of their types."""
    typed = tl.typed_arguments(tl.tool_calls(d.tool_logs(spark, sf_dir), d.KNOWN_TOOLS))
    return typed.withColumns({c: F.col(c).cast("string") for c in ("int_value", "float_value", "bool_value")})


# --- groundedness ---------------------------------------------------------------------------------------------

def _risk_sql() -> str:
    from innsight.fixed_values import GROUNDED_PATTERNS, NUMERIC_CLAIM_PATTERN, QUOTE_PATTERN, RISK_PATTERNS

    def every(column, patterns):
        return ", ".join("regexp_extract_all({c}, '({p})', 1)".format(c=column, p=p) for p in patterns)

    def fuzzy(needle, threshold):
        words = f"list_distinct(regexp_extract_all(lower({needle}), '([\\p{{L}}\\p{{N}}_]+)', 1))"
        return (
            f"(contains(evidence, {needle}) OR (len({words}) > 0 AND "
            f"len(list_intersect({words}, words)) / CAST(len({words}) AS DOUBLE) >= {threshold}))"
        )

    context = (
        "substr(low, CAST(greatest(0, position(m IN low) - 51) + 1 AS BIGINT), CAST(least(length(low), position(m IN low) - 1 + length(m) + 50) "
        "- greatest(0, position(m IN low) - 51) AS BIGINT))"
    )

    def added(amount, count, start="0.0::DOUBLE"):
        return f"list_reduce(list_concat([{start}], list_transform(range({count}), lambda i: {amount}::DOUBLE)), lambda a, b: a + b)"

    return f"""
turns AS (SELECT c.conv_id, c.turn, c.role, c.text, b.text AS before FROM conversations c JOIN conversations b ON c.conv_id = b.conv_id AND c.turn = b.turn + 1),
responses AS (
  SELECT conv_id, turn, text || ' Many guests mention ' || before || '. They wrote "' || replace(before, '"', '')
    || '" and "' || replace(text, '"', '') || '". Rating: ' || turn ||
    CASE WHEN role = 'user' THEN '. According to reviews, guests reported noise; no information found' ELSE '. Search results show it. Several people complained' END || '.' AS response,
    [before, 'no rating, score: ' || (turn - 1)] AS outputs FROM turns),
lowered AS (SELECT *, lower(response) AS low, lower(array_to_string(outputs, chr(10))) AS evidence FROM responses),
prepared AS (SELECT *, list_distinct(regexp_extract_all(evidence, '([\\p{{L}}\\p{{N}}_]+)', 1)) AS words,
    flatten([{every('low', RISK_PATTERNS)}]) AS risky, flatten([{every('low', GROUNDED_PATTERNS)}]) AS grounded,
    regexp_extract_all(response, '{QUOTE_PATTERN}', 1) AS quoted, regexp_extract_all(low, '{NUMERIC_CLAIM_PATTERN}', 1) AS numbers FROM lowered),
counted AS (SELECT conv_id, turn, len(risky) AS risk_phrases,
    len(list_filter(risky, lambda m: NOT {fuzzy(context, 0.5)})) AS unsupported_phrases, len(grounded) AS grounded_phrases,
    len(quoted) AS quotes, len(list_filter(quoted, lambda q: NOT {fuzzy('lower(q)', 0.7)})) AS unsupported_quotes,
    len(numbers) AS numeric_claims, len(list_filter(numbers, lambda n: NOT contains(evidence, n))) AS unsupported_numbers,
    (contains(low, 'no information found') OR contains(low, 'not found'))
      AND len(list_filter(outputs, lambda t: contains(lower(t), 'no') OR length(trim(t, ' ' || chr(9) || chr(10) || chr(13))) < 50)) = len(outputs) AS honest FROM prepared),
risk1 AS (SELECT *, {added(0.15, 'unsupported_phrases')} AS r1 FROM counted),
risk2 AS (SELECT *, CASE WHEN grounded_phrases > 0 THEN greatest(0.0::DOUBLE, r1 - grounded_phrases * 0.05::DOUBLE) ELSE r1 END AS r2 FROM risk1),
risk3 AS (SELECT *, {added(0.2, 'unsupported_quotes', 'r2')} AS r3 FROM risk2),
risk4 AS (SELECT *, {added(0.1, 'unsupported_numbers', 'r3')} AS r4 FROM risk3),
risks AS (SELECT *, least(1.0::DOUBLE, CASE WHEN honest THEN greatest(0.0::DOUBLE, r4 - 0.1::DOUBLE) ELSE r4 END) AS r FROM risk4)
"""


@query(with_sql(
    """SELECT conv_id, turn, CAST(risk_phrases AS INTEGER) AS risk_phrases, CAST(unsupported_phrases AS INTEGER) AS unsupported_phrases,
       CAST(grounded_phrases AS INTEGER) AS grounded_phrases, CAST(quotes AS INTEGER) AS quotes, CAST(unsupported_quotes AS INTEGER) AS unsupported_quotes,
       CAST(numeric_claims AS INTEGER) AS numeric_claims, CAST(unsupported_numbers AS INTEGER) AS unsupported_numbers, honest,
       round(r, 2) AS risk, r < 0.2 AS is_valid, round(r, 2) > 0.3 AS blocked FROM risks""", _risk_sql()))
def groundedness(spark, sf_dir):
    """H5 H6 H7: risk of responses against the turn they answer, strict mode with the block flag."""
    scored = gr.score_responses(d.responses(spark, sf_dir), strict=True)
    return scored.select(
        "conv_id", "turn", "risk_phrases", "unsupported_phrases", "grounded_phrases", "quotes", "unsupported_quotes",
        "numeric_claims", "unsupported_numbers", "honest", "risk", "is_valid", "blocked",
    )


# --- evaluation --------------------------------------------------------------------------------------------------

@query(with_sql("SELECT scenario_id, routing_correct, success FROM scenario_runs", d.SCENARIO_RUNS_SQL))
def scenario_scores(spark, sf_dir):
    """H8: routing and success of every scenario run."""
    return ev.score_scenarios(d.scenario_runs(spark, sf_dir)).select("scenario_id", "routing_correct", "success")


@query(with_sql(
    """SELECT category, count(*) AS total_tests, count(*) FILTER (success) AS successful, count(*) FILTER (routing_correct) AS routing_correct,
       count(*) FILTER (success) / CAST(count(*) AS DOUBLE) AS success_rate, count(*) FILTER (routing_correct) / CAST(count(*) AS DOUBLE) AS routing_accuracy,
       round(avg(coalesce(elapsed_seconds, 0.0)), 10) AS avg_response_time FROM scenario_runs GROUP BY category""", d.SCENARIO_RUNS_SQL))
def scenario_summary(spark, sf_dir):
    """Success, routing and time per category."""
    summary = ev.scenario_summary(ev.score_scenarios(d.scenario_runs(spark, sf_dir)), ["category"])
    return summary.withColumn("avg_response_time", F.round("avg_response_time", 10))


_RATINGS = r"""
ratings AS (
  SELECT session_id, unnest(['relevance', 'accuracy', 'actionability', 'speed', 'overall']) AS dimension,
         unnest([relevance, accuracy, actionability, speed, overall]) AS rating FROM feedback),
means AS (SELECT session_id, dimension, avg(CASE WHEN rating <> 0 THEN rating END) AS mean_rating,
  count(CASE WHEN rating <> 0 THEN rating END) AS n FROM ratings GROUP BY ALL),
sessions AS (SELECT session_id, count(*) AS n, count(*) FILTER (would_use_again) / CAST(nullif(count(would_use_again), 0) AS DOUBLE) AS would_use_again_share,
  avg(CASE WHEN elapsed_seconds <> 0 THEN elapsed_seconds END) AS avg_time, min(CASE WHEN elapsed_seconds <> 0 THEN elapsed_seconds END) AS min_time,
  max(CASE WHEN elapsed_seconds <> 0 THEN elapsed_seconds END) AS max_time FROM feedback GROUP BY session_id)
"""


@query(with_sql(
    """SELECT session_id, 'ratings' AS section, dimension AS metric, round(mean_rating, 10) AS value, n FROM means UNION ALL
       SELECT session_id, 'other', unnest(['would_use_again_share', 'avg_time', 'min_time', 'max_time']),
         round(unnest([would_use_again_share, avg_time, min_time, max_time]), 10), n FROM sessions""", d.FEEDBACK_SQL, _RATINGS))
def feedback_report(spark, sf_dir):
    """Mean ratings, share of returning users and times per session."""
    return ev.session_report(d.feedback(spark, sf_dir)).withColumn("value", F.round("value", 10))


@query("SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type AS comments FROM events")
def feedback_comments(spark, sf_dir):
    """H9: the comments of each session."""
    given = ev.comments(d.feedback(spark, sf_dir), order="ts")
    return given.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(with_sql(
    """SELECT 'results' AS part, count(*) AS n, count(*) FILTER (success) AS successful FROM scenario_runs UNION ALL
       SELECT 'summary', count(*), count(*) FILTER (success) FROM scenario_runs""", d.SCENARIO_RUNS_SQL))
def json_results(spark, sf_dir):
    """Scored runs and their summary as JSON, read back."""
    scored = ev.score_scenarios(d.scenario_runs(spark, sf_dir))
    paths = tables.write_json_results(scored, ev.scenario_summary(scored), shared_folder(spark, "results"))
    results = spark.read.schema("success boolean").json(paths["results"]).select(
        F.lit("results").alias("part"), F.lit(1).cast("bigint").alias("n"), F.col("success").cast("bigint").alias("successful")
    )
    summary = spark.read.schema("total_tests bigint, successful bigint").json(paths["summary"]).select(
        F.lit("summary").alias("part"), F.col("total_tests").alias("n"), "successful"
    )
    return results.unionByName(summary).groupBy("part").agg(F.sum("n").alias("n"), F.sum("successful").alias("successful"))
