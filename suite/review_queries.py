"""Sentences, topics, neighbours and the comparison report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from innsight.fixed_values import ERROR_MESSAGE_CHARS
from innsight.functions import text as tx
from innsight.functions import vectors
from innsight.operators import boundaries as bd
from innsight.operators import dictionary as dy
from innsight.operators import neighbours as nb
from innsight.operators import report as rp
from innsight.operators import sentences as st
from innsight.operators import topics as tp
from innsight.operators import word_sentiment as ws
from innsight.operators import word_vectors as wv
from innsight.plans import property_comparison as pc
from innsight.sources import tables
from innsight.sources.shared import discarded, shared_folder
from suite import derive as d
from suite.derive import costly, table, with_sql
from suite.registry import query

_STATS = (d.SOURCE_SENTENCES_SQL, d.ASSIGNMENTS_SQL)
_GAPS = r"""
topic_counts AS (
  SELECT property_id, topic, count(*) AS n, count(*) FILTER (sentiment_label = 'negative') AS neg
  FROM enriched GROUP BY ALL),
around AS (
  SELECT s.property_id, topic, CAST(sum(n) AS BIGINT) AS n, CAST(sum(neg) AS BIGINT) AS neg
  FROM source_neighbours s JOIN topic_counts c ON c.property_id = s.neighbor_property_id GROUP BY ALL),
topic_gaps AS (
  SELECT coalesce(o.property_id, a.property_id) AS property_id, coalesce(o.topic, a.topic) AS topic,
         coalesce(o.n, 0) AS target_n, coalesce(o.neg, 0) AS target_neg, coalesce(a.n, 0) AS neighbors_n,
         coalesce(a.neg, 0) AS neighbors_neg,
         coalesce(o.neg / CAST(o.n AS DOUBLE), 0.0::DOUBLE) AS target_rate,
         coalesce(a.neg / CAST(a.n AS DOUBLE), 0.0::DOUBLE) AS neighbors_rate,
         coalesce(o.neg / CAST(o.n AS DOUBLE), 0.0::DOUBLE) - coalesce(a.neg / CAST(a.n AS DOUBLE), 0.0::DOUBLE) AS gap
  FROM topic_counts o FULL JOIN around a ON o.property_id = a.property_id AND o.topic = a.topic),
ranked_topics AS (
  SELECT * FROM (
    SELECT *, 'weakness' AS kind, CAST(row_number() OVER (PARTITION BY property_id ORDER BY gap DESC, topic) AS INTEGER) AS rank
    FROM topic_gaps UNION ALL
    SELECT *, 'strength', CAST(row_number() OVER (PARTITION BY property_id ORDER BY gap, topic) AS INTEGER) FROM topic_gaps)
  WHERE rank <= 4)
"""
_EVIDENCE = r"""
labelled AS (SELECT * FROM enriched WHERE sentiment_label IN ('positive', 'negative')),
own_evidence AS (
  SELECT property_id, property_id AS evidence_property_id, topic, 'target_' || sentiment_label AS evidence_role,
         review_idx, sent_idx, sentence_id, topic_similarity, sentiment_label, sentence_text FROM labelled),
near_evidence AS (
  SELECT s.property_id, e.property_id AS evidence_property_id, topic, 'neighbors_' || sentiment_label AS evidence_role,
         review_idx, sent_idx, sentence_id, topic_similarity, sentiment_label, sentence_text
  FROM labelled e JOIN source_neighbours s ON e.property_id = s.neighbor_property_id),
evidence AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY property_id, topic, evidence_role
      ORDER BY topic_similarity DESC, evidence_property_id, review_idx, sent_idx, sentence_id) AS INTEGER) AS evidence_rank
    FROM (SELECT * FROM own_evidence UNION ALL SELECT * FROM near_evidence)) WHERE evidence_rank <= 3)
"""
_REPORT = (d.SOURCE_SENTENCES_SQL, d.ASSIGNMENTS_SQL, d.SOURCE_NEIGHBOURS_SQL, _GAPS)


def _six(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


# --- vectors and neighbours -----------------------------------------------------------------

@query(with_sql(
    """SELECT property_id, round(sqrt(list_dot_product(vec, vec)), 6) AS norm,
       round(list_dot_product(vec, [x / 64.0::DOUBLE FOR x IN range(64)]::DOUBLE[]), 6) AS dot,
       round(list_cosine_similarity(vec, [x / 64.0::DOUBLE FOR x IN range(64)]::DOUBLE[]), 6) AS cosine
       FROM vector_listings""", d.VECTOR_LISTINGS_SQL))
def vector_functions(spark, sf_dir):
    """Dot product, norm and cosine with a fixed direction."""
    listings = d.vector_listings(spark, sf_dir)
    vec = vectors.double_array(listings, "similarity_vec")
    ramp = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / F.lit(64.0))
    return listings.select(
        "property_id", F.round(vectors.l2_norm(vec), 6).alias("norm"), F.round(vectors.dot(vec, ramp), 6).alias("dot"),
        F.round(vectors.cosine(vec, ramp), 6).alias("cosine"),
    )


@query(with_sql(
    """SELECT property_id, neighbor_property_id, round(similarity, 6) AS similarity, rank FROM vector_neighbours""",
    d.VECTOR_LISTINGS_SQL))
def neighbours_topk(spark, sf_dir):
    """J1 P18 F1-F3 T1 for all properties: the 20 nearest in the cell of each target's resolution."""
    near = nb.top_neighbours(d.vector_listings(spark, sf_dir), k=20)
    return near.select("property_id", "neighbor_property_id", *_six("similarity"), "rank")


@query(with_sql(
    """SELECT property_id, count(*) AS neighbors_selected_count, round(avg(similarity), 6) AS similarity_avg,
       round(min(similarity), 6) AS similarity_min, round(max(similarity), 6) AS similarity_max
       FROM vector_neighbours GROUP BY property_id""", d.VECTOR_LISTINGS_SQL))
def neighbour_stats(spark, sf_dir):
    """A4 over T1."""
    stats = nb.similarity_stats(nb.top_neighbours(d.vector_listings(spark, sf_dir), k=20))
    return stats.select("property_id", "neighbors_selected_count", *_six("similarity_avg", "similarity_min", "similarity_max"))


@query(with_sql(
    """SELECT t.property_id AS target_property_id, m.property_id FROM (
         SELECT min(property_id) AS property_id, geo_bucket_res, geo_bucket FROM vector_listings
         GROUP BY geo_bucket_res, geo_bucket) t
       JOIN vector_members m ON t.geo_bucket_res = m.res AND t.geo_bucket = m.cell""", d.VECTOR_LISTINGS_SQL))
def geo_neighbourhood(spark, sf_dir):
    """J1 with the target kept: the members of every cell, asked for by one property of it."""
    listings = d.vector_listings(spark, sf_dir)
    targets = listings.groupBy("geo_bucket_res", "geo_bucket").agg(F.min("property_id").alias("property_id"))
    return nb.neighbourhood(listings, targets)


@query(with_sql(
    """SELECT property_id, res, cell FROM (
         SELECT *, row_number() OVER (PARTITION BY res, cell ORDER BY sha256('42:' || property_id), property_id) AS rn
         FROM vector_members) WHERE rn <= 50""", d.VECTOR_LISTINGS_SQL))
def candidate_sample(spark, sf_dir):
    """A repeatable sample of at most 50 candidates per cell."""
    cells = nb.listing_cells(d.vector_listings(spark, sf_dir))
    return nb.sample_candidates(cells, 50, ["res", "cell"])


@query(with_sql(
    """drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY res, cell ORDER BY sha256('42:' || property_id), property_id) AS n
         FROM vector_members) WHERE n <= 31)
       SELECT property_id, neighbor_property_id, rank FROM (
         SELECT t.property_id, m.property_id AS neighbor_property_id, CAST(row_number() OVER (PARTITION BY t.property_id
           ORDER BY round(list_cosine_similarity(t.vec, m.vec), 9) DESC, m.property_id) AS INTEGER) AS rank
         FROM vector_listings t JOIN drawn m ON t.geo_bucket_res = m.res AND t.geo_bucket = m.cell
         WHERE t.property_id <> m.property_id) WHERE rank <= 10""", d.VECTOR_LISTINGS_SQL))
def sampled_neighbours(spark, sf_dir):
    """Neighbours among a repeatable sample of 30 candidates per cell."""
    near = nb.top_neighbours(d.vector_listings(spark, sf_dir), k=10, max_candidates=30)
    return near.select("property_id", "neighbor_property_id", "rank")


@query("""SELECT CAST(vec_id AS VARCHAR) AS property_id, 'geo-' || label AS bucket
          FROM embeddings WHERE label NOT IN (3, 4, 5, 6)""")
def usable_listings(spark, sf_dir):
    """Listings whose vector is present, finite and not zero, with the fallback bucket column."""
    e = table(spark, sf_dir, "embeddings")
    double = F.col("embedding").cast("array<double>")
    vec = (
        F.when(F.col("label") == 3, F.transform(double, lambda x: x * 0))
        .when(F.col("label") == 4, F.concat(F.slice(double, 1, 63), F.array(F.lit(float("nan")))))
        .when(F.col("label") != 5, double)
    )
    listings = e.select(
        F.col("vec_id").cast("string").alias("property_id"), vec.alias("similarity_vec"), (F.col("label") == 6).alias("is_bad_vec"),
        F.concat(F.lit("geo-"), F.col("label").cast("string")).alias("_geo_bucket_filled"),
    )
    return nb.usable_vectors(listings).select("property_id", F.col(nb.geo_column(listings)).alias("bucket"))


@query(with_sql(
    """requested AS (SELECT property_id FROM vector_listings UNION ALL SELECT 'x' || CAST(label AS VARCHAR) FROM embeddings),
       cells AS (SELECT res, cell, count(*) AS n FROM vector_members GROUP BY ALL)
       SELECT r.property_id AS target_property_id, CASE WHEN l.property_id IS NULL THEN 'target_not_found' ELSE 'ok' END AS status,
              coalesce(geo_bucket_res, -1) AS bucket_res, geo_bucket AS bucket_value, coalesce(n - 1, -1) AS bucket_candidate_count,
              CASE WHEN l.property_id IS NOT NULL THEN round(least(1.0::DOUBLE, 170.0::DOUBLE / greatest(n - 1, 1)), 6) END AS candidate_sampling_fraction
       FROM (SELECT DISTINCT property_id FROM requested) r LEFT JOIN vector_listings l ON r.property_id = l.property_id
       LEFT JOIN cells c ON l.geo_bucket_res = c.res AND l.geo_bucket = c.cell""",
    d.VECTOR_LISTINGS_SQL))
def neighbour_status(spark, sf_dir):
    """Selection metadata for every property, and for ids that do not exist."""
    listings = d.vector_listings(spark, sf_dir)
    absent = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("x"), F.col("label").cast("string")).alias("property_id"))
    status = nb.neighbour_status(listings, listings.select("property_id").unionByName(absent), max_candidates=100)
    return status.select(
        "target_property_id", "status", F.coalesce("bucket_res", F.lit(-1)).alias("bucket_res"), "bucket_value",
        F.coalesce("bucket_candidate_count", F.lit(-1)).alias("bucket_candidate_count"),
        *_six("candidate_sampling_fraction"),
    )


@query(with_sql(
    "SELECT property_id, neighbor_property_id, round(similarity, 6) AS similarity, rank FROM source_neighbours",
    d.SOURCE_NEIGHBOURS_SQL))
def source_neighbours(spark, sf_dir):
    """T1 over the sources' language profiles; the neighbours the report queries use."""
    near = nb.top_neighbours(d.source_listings(spark, sf_dir), k=5)
    return near.select("property_id", "neighbor_property_id", *_six("similarity"), "rank")


# --- sentences --------------------------------------------------------------------------------

@query(with_sql("SELECT * FROM review_rows", d.REVIEW_ROWS_SQL))
def review_rows(spark, sf_dir):
    """Every review of the JSON arrays, normalised."""
    return st.explode_reviews(d.review_listings(spark, sf_dir)).select("property_id", "review_idx", "review_text")


@query(with_sql("SELECT * FROM review_rows WHERE review_idx < 50", d.REVIEW_ROWS_SQL))
def first_reviews(spark, sf_dir):
    """the first 50 reviews of each listing."""
    listings = d.review_listings(spark, sf_dir)
    return st.explode_reviews(listings, max_reviews=50).select("property_id", "review_idx", "review_text")


@query(with_sql("SELECT property_id, review_idx, sent_idx, sentence_id, sentence_text FROM sentence_rows",
                d.REVIEW_ROWS_SQL, d.SENTENCE_ROWS_SQL))
def sentences(spark, sf_dir):
    """All sentences with their content ids."""
    return st.split_sentences(st.explode_reviews(d.review_listings(spark, sf_dir)))


@query(with_sql("SELECT property_id, count(DISTINCT sentence_id) AS distinct_sentences FROM source_sentences GROUP BY property_id",
                d.SOURCE_SENTENCES_SQL))
def distinct_sentences(spark, sf_dir):
    """A3: distinct sentences per property."""
    return st.distinct_sentences(d.source_sentences(spark, sf_dir))


@query(with_sql(
    """volume AS (SELECT property_id, count(DISTINCT sentence_id) AS n FROM source_sentences GROUP BY property_id)
       SELECT s.property_id, t.n AS target_distinct_sentences_used, CAST(sum(v.n) AS BIGINT) AS neighbors_distinct_sentences_used
       FROM source_neighbours s JOIN volume t ON s.property_id = t.property_id
       JOIN volume v ON s.neighbor_property_id = v.property_id GROUP BY ALL""",
    d.SOURCE_SENTENCES_SQL, d.SOURCE_NEIGHBOURS_SQL))
def sentence_volume(spark, sf_dir):
    """Sentences of each target and of its neighbours together."""
    near = nb.top_neighbours(d.source_listings(spark, sf_dir), k=5)
    return st.sentence_volume(d.source_sentences(spark, sf_dir), near)


@query("""SELECT doc_id, regexp_matches(text, '[A-Za-z]')
          AND length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) <= 0.02 AS english_like
          FROM documents""")
def english_like(spark, sf_dir):
    """P16 on whole texts; the share is lowered so that the languages differ."""
    return costly(spark, sf_dir, "documents").select("doc_id", tx.english_like(F.col("text"), 0.02).alias("english_like"))


_POSITIVE = ["and", "with", "für", "pour", "para"]
_NEGATIVE = ["of", "that", "nicht", "les", "los"]


def _count_words(words):
    return " + ".join(f"len(list_filter(tokens, lambda t: t = '{w}'))" for w in words)


@query(with_sql(
    f"""tokens AS (SELECT property_id, sentence_id, regexp_extract_all(lower(sentence_text), '([\\p{{L}}\\p{{N}}_]+)', 1) AS tokens
         FROM sentence_rows)
       SELECT property_id, sentence_id, CASE WHEN {_count_words(_POSITIVE)} > {_count_words(_NEGATIVE)} THEN 'positive'
         WHEN {_count_words(_POSITIVE)} < {_count_words(_NEGATIVE)} THEN 'negative' ELSE 'na' END AS sentiment_label
       FROM tokens""", d.REVIEW_ROWS_SQL, d.SENTENCE_ROWS_SQL))
def sentence_sentiment(spark, sf_dir):
    """X3 by word lists, on all sentences."""
    rows = st.split_sentences(st.explode_reviews(d.review_listings(spark, sf_dir)))
    return st.lexicon_sentiment(rows, _POSITIVE, _NEGATIVE).select("property_id", "sentence_id", "sentiment_label")


def _bayes_sql() -> str:
    negations = ", ".join("'" + w.replace("'", "''") + "'" for w in ws.NEGATIONS)
    return f"""
marked AS (
  SELECT property_id, review_idx, sent_idx, sentiment_label, flatten(list_transform(
      list_transform(regexp_split_to_array(lower(sentence_text), '[.,;:!?\\n]+'), lambda c: regexp_extract_all(c, '[\\p{{L}}\\p{{N}}_'']+')),
      lambda w: list_transform(w, lambda x, i: CASE WHEN i > list_min(list_filter(list_transform([{negations}], lambda g: list_position(w, g)), lambda p: p > 0))
        THEN 'not_' || x ELSE x END))) AS features
  FROM source_sentences),
labels AS (SELECT sentiment_label AS label, count(*) AS of_label, sum(count(*)) OVER () AS of_all FROM marked WHERE sentiment_label <> 'na' GROUP BY sentiment_label),
counts AS (
  SELECT feature, label, count(*) AS n, count(DISTINCT (property_id, review_idx, sent_idx)) AS texts FROM (
    SELECT property_id, review_idx, sent_idx, sentiment_label AS label, unnest(features) AS feature FROM marked WHERE sentiment_label <> 'na')
  GROUP BY feature, label),
grid AS (
  SELECT f.feature, l.label, l.of_label, l.of_all, coalesce(c.n, 0) AS n, coalesce(c.texts, 0) AS texts, f.having_it
  FROM (SELECT feature, sum(texts) AS having_it FROM counts GROUP BY feature) f CROSS JOIN labels l
  LEFT JOIN counts c ON c.feature = f.feature AND c.label = l.label),
chosen AS (
  SELECT feature, 2 * sum(CASE WHEN texts > 0 THEN texts * ln(texts * of_all / CAST(having_it * of_label AS DOUBLE)) ELSE 0 END
    + CASE WHEN of_label > texts THEN (of_label - texts) * ln((of_label - texts) * of_all / CAST((of_all - having_it) * of_label AS DOUBLE)) ELSE 0 END) AS ratio
  FROM grid GROUP BY feature HAVING ratio >= {ws.LEAST_RATIO}),
weights AS (
  SELECT feature, label, ln((n + 1) / CAST(sum(n + 1) OVER (PARTITION BY label) AS DOUBLE)) AS weight
  FROM grid WHERE feature IN (SELECT feature FROM chosen)),
scores AS (
  SELECT property_id, review_idx, sent_idx, w.label, round(sum(weight) + ln(any_value(l.of_label) / CAST(any_value(l.of_all) AS DOUBLE)), 9) AS score
  FROM (SELECT property_id, review_idx, sent_idx, unnest(features) AS feature FROM marked) m JOIN weights w ON w.feature = m.feature
  JOIN labels l ON l.label = w.label GROUP BY property_id, review_idx, sent_idx, w.label),
judged AS (
  SELECT m.property_id, m.review_idx, m.sent_idx, coalesce(s.label, (SELECT label FROM labels ORDER BY of_label DESC, label LIMIT 1)) AS label
  FROM marked m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY property_id, review_idx, sent_idx ORDER BY score DESC, label) AS n FROM scores) s
    ON s.n = 1 AND s.property_id = m.property_id AND s.review_idx = m.review_idx AND s.sent_idx = m.sent_idx)
"""


_SENTENCE_KEY = ("property_id", "review_idx", "sent_idx")


@query(with_sql("SELECT w.feature, w.label, round(weight, 6) AS weight, round(ratio, 4) AS ratio FROM weights w JOIN chosen c ON c.feature = w.feature",
                d.SOURCE_SENTENCES_SQL, _bayes_sql()))
def sentiment_features(spark, sf_dir):
    """The words that tell labels apart, negated ones on their own, with their weights."""
    rows = d.source_sentences(spark, sf_dir).filter(F.col("sentiment_label") != "na")
    weights, _ = ws.fit(rows)
    counts = d.stored(ws.feature_counts(rows), "feature-counts")
    chosen = ws.chosen_features(counts, ws.label_counts(rows))
    return weights.join(chosen, "feature").select("feature", "label", *_six("weight"), F.round("ratio", 4).alias("ratio"))


@query(with_sql("SELECT property_id, label AS sentiment_label, count(*) AS sentences FROM judged GROUP BY ALL", d.SOURCE_SENTENCES_SQL, _bayes_sql()))
def trained_sentiment(spark, sf_dir):
    """X3 by naive Bayes with negation: trained on the labelled sentences, applied to all."""
    rows = d.source_sentences(spark, sf_dir)
    model = ws.fit(rows.filter(F.col("sentiment_label") != "na"))
    return ws.apply(rows, model, _SENTENCE_KEY).groupBy("property_id", "sentiment_label").agg(F.count("*").alias("sentences"))


_STOPS_SQL = r"""
stop_tokens AS (
  SELECT property_id, review_idx, CAST(i AS BIGINT) AS i, t AS raw, t = '' AS void,
    regexp_replace(regexp_replace(t, '^["''(\[{«„“‚‘]+', ''), '["'')\]}»“”’,;:]+$', '') AS t FROM (
    SELECT property_id, review_idx, unnest(w) AS t, unnest(range(len(w))) AS i
    FROM (SELECT property_id, review_idx, regexp_split_to_array(lower(review_text), '[ \t\n\x0B\f\r]+') AS w FROM review_rows))),
types AS (
  SELECT regexp_replace(t, '\.$', '') AS type, count(*) FILTER (ends_with(t, '.')) AS with_stop, count(*) FILTER (NOT ends_with(t, '.')) AS without_stop
  FROM stop_tokens WHERE regexp_matches(t, '^\p{L}[\p{L}.''-]*$') GROUP BY ALL),
stop_rate AS (SELECT sum(with_stop) / CAST(sum(with_stop + without_stop) AS DOUBLE) AS rate FROM types),
scored AS (
  SELECT type, with_stop, without_stop, length(type) - length(replace(type, '.', '')) AS inner_stops,
    2 * (with_stop * (ln(0.99) - ln(rate)) + without_stop * (ln(1 - 0.99::DOUBLE) - ln(1 - rate))) AS ratio
  FROM types, stop_rate WHERE with_stop > 0),
abbreviations AS (
  SELECT *, ratio * exp(-(length(type) - inner_stops)) * (inner_stops + 1) * pow(length(type) - inner_stops, -CAST(without_stop AS DOUBLE)) AS score FROM scored)
"""


@query(with_sql(
    "SELECT type, with_stop, without_stop, round(ratio, 4) AS ratio, score >= 0.3 AS is_abbreviation FROM abbreviations",
    d.REVIEW_ROWS_SQL, _STOPS_SQL))
def boundary_statistics(spark, sf_dir):
    """How every word of all reviews stands to the full stop, and which are abbreviations."""
    reviews = st.explode_reviews(d.review_listings(spark, sf_dir))
    scored = bd.abbreviation_scores(bd.type_counts(reviews))
    return scored.select(
        "type", "with_stop", "without_stop", F.round("ratio", 4).alias("ratio"), (F.col("score") >= bd.LEAST_SCORE).alias("is_abbreviation")
    )


@query(with_sql(
    r"""follows AS (
         SELECT property_id, review_idx, i, t, raw, lead(t) OVER (PARTITION BY property_id, review_idx ORDER BY i) AS after,
           lag(t) OVER (PARTITION BY property_id, review_idx ORDER BY i) AS before FROM stop_tokens WHERE NOT void),
       numbered AS (
         SELECT regexp_replace(t, '\.$', '') AS type, count(*) FILTER (coalesce(regexp_matches(before, '^[0-9]+\.$'), false)) AS a, count(*) AS n
         FROM follows WHERE regexp_matches(t, '^\p{L}[\p{L}.''-]*$') GROUP BY ALL),
       whole AS (SELECT sum(a) AS a_all, sum(n) AS n_all FROM numbered),
       rates AS (
         SELECT type, CAST(a AS DOUBLE) AS a, CAST(n AS DOUBLE) AS n, CAST(a_all AS DOUBLE) AS a_all, CAST(n_all AS DOUBLE) AS n_all,
           greatest(1e-12, least(1 - 1e-12, a / CAST(n AS DOUBLE))) AS p, greatest(1e-12, least(1 - 1e-12, a_all / CAST(n_all AS DOUBLE))) AS p0,
           greatest(1e-12, least(1 - 1e-12, (a_all - a) / greatest(CAST(n_all - n AS DOUBLE), 1))) AS p1 FROM numbered, whole WHERE a > 0),
       ordinals AS (SELECT type FROM rates WHERE a / n > a_all / n_all AND 2 * (a * ln(p) + (n - a) * ln(1 - p) + (a_all - a) * ln(p1)
         + (n_all - n - a_all + a) * ln(1 - p1) - a_all * ln(p0) - (n_all - a_all) * ln(1 - p0)) >= 7.88),
       ends AS (
         SELECT property_id, review_idx, after IS NULL OR (regexp_matches(raw, '[.!?…]+["'')\]}»“”’]*$') AND NOT (
             ends_with(t, '.') AND NOT ends_with(t, '..') AND (regexp_matches(t, '^\p{L}\.$')
             OR t[:-2] IN (SELECT type FROM abbreviations WHERE score >= 0.3)
             OR (regexp_matches(t, '^[0-9]+\.$') AND regexp_replace(regexp_replace(after, '[!?]+$', ''), '\.$', '') IN (SELECT type FROM ordinals))))) AS is_end
         FROM follows)
       SELECT property_id, review_idx, count(*) FILTER (is_end) AS sentences FROM ends GROUP BY ALL""",
    d.REVIEW_ROWS_SQL, _STOPS_SQL))
def learnt_sentences(spark, sf_dir):
    """Sentences of every review, cut at boundaries learnt from all of them."""
    reviews = st.explode_reviews(d.review_listings(spark, sf_dir))
    cut = bd.split_learnt(reviews, bd.learn(reviews))
    return cut.groupBy("property_id", "review_idx").agg(F.count("*").alias("sentences"))


# --- topics -------------------------------------------------------------------------------------

@query(with_sql("SELECT property_id, sentence_id, topic, round(topic_similarity, 6) AS topic_similarity FROM assignments", *_STATS))
def topic_keyword_tag(spark, sf_dir):
    """X5 W1 P16 by keywords: the two best topics of every English-like sentence."""
    tagged = d.source_assignments(d.source_sentences(spark, sf_dir))
    return tagged.select("property_id", "sentence_id", "topic", *_six("topic_similarity"))


_VOCABULARY = sorted({w for words in (["the", "this", "that"], ["of", "with", "from"], ["was", "are", "be"], ["to", "for", "on"]) for w in words})
_VECTOR_TOPICS = {"determiners": ["the", "this", "that"], "prepositions": ["of", "with", "from"],
                  "verb forms": ["was", "are", "be"], "purpose": ["to", "for", "on"]}


def _vector_sql() -> str:
    counts = ", ".join(f"len(list_filter(tokens, lambda t: t = '{w}'))" for w in _VOCABULARY)
    topics = ", ".join(
        f"('{t}', [{', '.join(str(int(w in words)) for w in _VOCABULARY)}]::DOUBLE[])" for t, words in _VECTOR_TOPICS.items()
    )
    return f"""
sentence_vectors AS (
  SELECT property_id, sentence_id, [{counts}]::DOUBLE[] AS vec FROM (
    SELECT property_id, sentence_id, regexp_extract_all(lower(sentence_text), '([\\p{{L}}\\p{{N}}_]+)', 1) AS tokens
    FROM english_sentences)),
topic_vectors AS (SELECT * FROM (VALUES {topics}) v(topic, vec)),
vector_scores AS (
  SELECT property_id, sentence_id, topic, round(list_cosine_similarity(s.vec, t.vec), 9) AS topic_similarity
  FROM sentence_vectors s, topic_vectors t WHERE list_sum(s.vec) > 0)
"""


@query(with_sql(
    """SELECT property_id, sentence_id, topic, round(topic_similarity, 6) AS topic_similarity FROM (
         SELECT *, row_number() OVER (PARTITION BY property_id, sentence_id ORDER BY topic_similarity DESC, topic) AS rn
         FROM vector_scores WHERE topic_similarity >= 0.35) WHERE rn <= 2""",
    d.SOURCE_SENTENCES_SQL, _vector_sql()))
def topic_vector_tag(spark, sf_dir):
    """X4 X5 J4 F3 W1 by vectors: cosine of word counts with topic vectors, threshold 0.35, best two."""
    rows = d.source_sentences(spark, sf_dir)
    model = st.vocabulary_embedding(spark, _VOCABULARY)
    topics = spark.createDataFrame([(t, " ".join(w)) for t, w in _VECTOR_TOPICS.items()], "topic string, sentence_text string")
    vectors_of_topics = st.embed(topics, model).select("topic", "vector")
    tagged = tp.topics_by_vector(st.embed(rows, model), vectors_of_topics, threshold=0.35, top_n=2)
    return tagged.select("property_id", "sentence_id", "topic", *_six("topic_similarity"))


@query()
def topic_hashed_tag(spark, sf_dir):
    """X4 X5 with a fitted embedding: sentences tagged with the benchmark passages they resemble."""
    rows = d.source_sentences(spark, sf_dir)
    model = st.fit_embedding(rows, dims=256)
    passages = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("topic"), F.lower("text").alias("sentence_text")
    )
    vectors_of_topics = st.embed(passages, model).select("topic", "vector")
    tagged = tp.topics_by_vector(st.embed(rows, model), vectors_of_topics, threshold=0.35, top_n=2)
    return tagged.groupBy("topic").agg(F.count("*").alias("sentences"), F.round(F.max("topic_similarity"), 4).alias("best"))


@query(with_sql("SELECT property_id, sentence_id, topic, round(topic_similarity, 6) AS topic_similarity FROM assignments", *_STATS))
def topic_dictionary_tag(spark, sf_dir):
    """X5 W1 with the keywords as a table, found by one automaton."""
    terms = spark.createDataFrame([(t, w) for t, words in d.TOPIC_WORDS.items() for w in words], "topic string, term string")
    tagged = dy.topics_by_terms(d.source_sentences(spark, sf_dir), terms)
    return tagged.select("property_id", "sentence_id", "topic", *_six("topic_similarity"))


@query(r"""
WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark)
SELECT doc_id, term, CAST(instr(lower(text), term) - 1 AS INTEGER) AS first FROM documents, terms WHERE contains(lower(text), term)
""")
def passage_words_mentioned(spark, sf_dir):
    """Every word of the benchmark passages in every document that contains it."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(wv.words_of(F.col("text"))).alias("term"))
    return dy.find_terms(costly(spark, sf_dir, "documents"), terms, ["doc_id"]).select("doc_id", "term", "first")


_PAIRS_SQL = r"""
tokens AS (SELECT regexp_extract_all(lower(sentence_text), '[\p{L}\p{N}_]+') AS w FROM source_sentences),
vocabulary AS (SELECT word FROM (SELECT unnest(w) AS word FROM tokens) GROUP BY word HAVING count(*) >= 20),
near AS (
  SELECT w[i] AS a, unnest(w[i + 1 : i + 5]) AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM tokens)),
pairs AS (
  SELECT word, context, count(*) AS n FROM (
    SELECT a AS word, b AS context FROM near WHERE a <> b UNION ALL SELECT b, a FROM near WHERE a <> b)
  WHERE word IN (SELECT word FROM vocabulary) AND context IN (SELECT word FROM vocabulary) GROUP BY word, context),
sums AS (SELECT word, sum(n) AS n FROM pairs GROUP BY word)
"""


@query(with_sql(
    """SELECT p.word, p.context, p.n, round(ln(CAST(p.n AS DOUBLE) * (SELECT sum(n) FROM pairs) / (CAST(a.n AS DOUBLE) * CAST(b.n AS DOUBLE))), 6) AS ppmi
       FROM pairs p JOIN sums a ON a.word = p.word JOIN sums b ON b.word = p.context
       WHERE CAST(p.n AS DOUBLE) * (SELECT sum(n) FROM pairs) / (CAST(a.n AS DOUBLE) * CAST(b.n AS DOUBLE)) > 1""",
    d.SOURCE_SENTENCES_SQL, _PAIRS_SQL))
def word_pairs(spark, sf_dir):
    """Words within five words of each other, and how much more often than by chance."""
    rows = d.source_sentences(spark, sf_dir)
    pairs = wv.ppmi(wv.pair_counts(rows, wv.word_counts(rows, min_count=20)))
    return pairs.withColumn("ppmi", F.round("ppmi", 6))


_MEANINGS = {"de": "und der nicht", "en": "the of and", "es": "los para que", "fr": "les pour que"}


@query()
def topic_by_meaning(spark, sf_dir):
    """X4 X5 by learnt vectors: sentences tagged with the topic their words keep company with.

    Counted apart by whether the sentence shares a word with its topic.
    """
    topics = spark.createDataFrame(list(_MEANINGS.items()), "topic string, sentence_text string")
    meant = {r["topic"]: r["words"] for r in topics.select("topic", wv.words_of(F.col("sentence_text")).alias("words")).collect()}
    noted = d.source_sentences(spark, sf_dir).withColumn("english", tx.english_like(F.col("sentence_text"), 1.0))
    rows = wv.split_texts(noted, (*_SENTENCE_KEY, "english"), marks=list(meant.values()))
    counts = wv.word_counts(rows)
    pairs = wv.pair_counts(rows, counts)
    words = wv.fit_words(wv.ppmi(pairs))
    discarded(pairs.blocks)
    tagged = tp.topics_by_vector(
        wv.with_sentence_vectors(rows, words, counts, _SENTENCE_KEY), wv.with_sentence_vectors(topics, words, counts, ("topic",)),
        threshold=0.2, top_n=1, max_non_ascii=1.0, keep=("review_idx", "marks"), english_col="english",
    )
    bit = F.element_at(F.create_map(*[F.lit(x) for k, topic in enumerate(meant) for x in (topic, k)]), F.col("topic"))
    shared = F.getbit("marks", bit) == 1
    of_texts = tagged.groupBy("review_idx", "topic", shared.alias("shares_a_word")).agg(F.count("*").alias("n"))
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("review_idx"), "lang")
    return of_texts.join(lang, "review_idx").groupBy("lang", "topic", "shares_a_word").agg(F.sum("n").alias("sentences"))


@query(with_sql(
    """SELECT property_id, review_idx, sent_idx, sentence_id, topic, round(topic_similarity, 6) AS topic_similarity,
       sentiment_label, sentence_text FROM enriched""", *_STATS))
def enriched_sentences(spark, sf_dir):
    """Sentences joined with their topics."""
    rows = d.source_sentences(spark, sf_dir)
    return rp.enrich(rows, d.source_assignments(rows)).withColumn("topic_similarity", F.round("topic_similarity", 6))


@query(with_sql(
    """SELECT property_id, topic, count(*) AS sentence_topic_assignments,
       count(*) FILTER (sentiment_label = 'negative') AS negative_assignments,
       count(*) FILTER (sentiment_label = 'negative') / CAST(count(*) AS DOUBLE) AS negative_rate
       FROM enriched GROUP BY ALL""", *_STATS))
def topic_stats(spark, sf_dir):
    """A1: assignments, negative assignments and negative rate per property and topic."""
    stats = rp.topic_stats(pc.keyword_tagger(d.TOPIC_WORDS)(d.source_sentences(spark, sf_dir)))
    return stats.select("property_id", "topic", "sentence_topic_assignments", "negative_assignments", "negative_rate")


_USER_TERMS = ["wifi", "Quiet ", "AC", "kitchen", "pricing", "air", "the view"]


@query("""SELECT conv_id, turn, term, matched_topic FROM conversations JOIN (SELECT * FROM (VALUES
          (0, 'wifi', 'wifi and internet quality'), (1, 'Quiet ', 'privacy and quietness'),
          (2, 'AC', 'temperature and climate control'), (3, 'kitchen', 'kitchen and cooking facilities'),
          (4, 'pricing', 'value for money and pricing'), (5, 'air', 'maintenance and repairs'), (6, 'the view', 'the view')) v(n, term, matched_topic))
          ON turn % 7 = n""")
def topic_aliases(spark, sf_dir):
    """The term asked about in every turn, to its topic by alias, then by substring."""
    turns = table(spark, sf_dir, "conversations")
    asked = F.get(tx.word_array(_USER_TERMS), F.pmod("turn", F.lit(len(_USER_TERMS))).cast("int"))
    return tp.resolve_topic(turns.select("conv_id", "turn", asked.alias("term")))


# --- the report ------------------------------------------------------------------------------------

@query(with_sql(
    """SELECT property_id, topic, target_n AS target_sentence_topic_assignments, target_neg AS target_negative_assignments,
       neighbors_n AS neighbors_sentence_topic_assignments, neighbors_neg AS neighbors_negative_assignments,
       target_rate AS target_negative_rate, neighbors_rate AS neighbors_negative_rate,
       gap AS negative_rate_gap FROM topic_gaps""", *_REPORT))
def topic_gaps(spark, sf_dir):
    """Each source against its neighbours, per topic."""
    gaps = rp.topic_gaps(*d.source_comparison(spark, sf_dir))
    return gaps.select(
        "property_id", "topic", "target_sentence_topic_assignments", "target_negative_assignments",
        "neighbors_sentence_topic_assignments", "neighbors_negative_assignments",
        "target_negative_rate", "neighbors_negative_rate", "negative_rate_gap",
    )


@query(with_sql("SELECT property_id, kind, rank, topic, gap AS negative_rate_gap FROM ranked_topics", *_REPORT))
def topic_gap_report(spark, sf_dir):
    """The four widest and narrowest gaps of each source."""
    ranked = rp.rank_topics(rp.topic_gaps(*d.source_comparison(spark, sf_dir)), 4)
    return ranked.select("property_id", "kind", "rank", "topic", "negative_rate_gap")


@query(with_sql(
    """SELECT t.property_id, kind, t.topic, evidence_role, evidence_rank, evidence_property_id, review_idx, sent_idx,
       sentence_id, round(topic_similarity, 6) AS topic_similarity, sentiment_label,
       CASE WHEN length(sentence_text) > 600 THEN substr(sentence_text, 1, 600) || '…' ELSE sentence_text END AS sentence_text
       FROM ranked_topics t JOIN evidence e ON t.property_id = e.property_id AND t.topic = e.topic""", *_REPORT, _EVIDENCE))
def topic_evidence(spark, sf_dir):
    """Three sentences per role for the reported topics."""
    enriched, near = d.source_comparison(spark, sf_dir)
    topics = rp.rank_topics(rp.topic_gaps(enriched, near), 4)
    rows = rp.capped_evidence(rp.evidence_of_topics(topics, rp.topic_evidence(enriched, near, 3)))
    return rows.withColumn("topic_similarity", F.round("topic_similarity", 6))


@query(with_sql(
    """SELECT t.property_id, kind, t.topic,
       count(*) FILTER (evidence_role = 'target_negative') AS n_target_negative,
       count(*) FILTER (evidence_role = 'target_positive') AS n_target_positive,
       count(*) FILTER (evidence_role = 'neighbors_positive') AS n_neighbors_positive,
       count(*) FILTER (evidence_role = 'neighbors_negative') AS n_neighbors_negative,
       coalesce(string_agg(CASE WHEN evidence_role = 'target_negative' THEN sentence_text END, ' / ' ORDER BY evidence_rank), '') AS lean_target_negative
       FROM ranked_topics t LEFT JOIN evidence e ON t.property_id = e.property_id AND t.topic = e.topic GROUP BY ALL""",
    *_REPORT, _EVIDENCE))
def report_with_examples(spark, sf_dir):
    """Evidence arrays per topic, empty where there is none, and their lean form."""
    enriched, near = d.source_comparison(spark, sf_dir)
    topics = rp.rank_topics(rp.topic_gaps(enriched, near), 4)
    full = rp.with_examples(topics, rp.topic_evidence(enriched, near, 3))
    lean = rp.lean_examples(full)
    return lean.select(
        "property_id", "kind", "topic",
        *[F.size(f"{role}_examples").cast("bigint").alias(f"n_{role}") for role in rp.ROLES],
        F.array_join("target_negative_examples", " / ").alias("lean_target_negative"),
    )


@query(with_sql(
    """SELECT property_id, topic, kind FROM (SELECT *, row_number() OVER (PARTITION BY property_id, topic
       ORDER BY CASE kind WHEN 'weakness' THEN 0 ELSE 1 END, rank) AS n FROM ranked_topics) WHERE n = 1""", *_REPORT))
def unique_report_topics(spark, sf_dir):
    """Weaknesses before strengths, each topic once."""
    topics = rp.rank_topics(rp.topic_gaps(*d.source_comparison(spark, sf_dir)), 4)
    return rp.unique_topics(topics).select("property_id", "topic", "kind")


@query(with_sql(
    """uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY property_id, topic
         ORDER BY CASE kind WHEN 'weakness' THEN 0 ELSE 1 END, rank) AS n FROM ranked_topics) WHERE n = 1),
       spans AS (SELECT property_id, quantile_cont(CAST(neighbors_n AS DOUBLE), 0.10) AS q1,
         quantile_cont(CAST(neighbors_n AS DOUBLE), 0.90) AS q2, min(neighbors_n) AS low, max(neighbors_n) AS high
         FROM uniq GROUP BY property_id),
       scale AS (SELECT property_id,
         CASE WHEN q2 > q1 THEN q1 WHEN high > low THEN low ELSE 0.0 END AS a,
         CASE WHEN q2 > q1 THEN q2 WHEN high > low THEN high ELSE 1.0 END AS b FROM spans)
       SELECT u.property_id, topic, round(0.0::DOUBLE - gap, 6) AS impact_x, round(ln(1 + target_n + neighbors_n), 6) AS confidence_y,
         round(30.0 + least(1.0, greatest(0.0, (neighbors_n - a) / (b - a))) * 1170.0, 6) AS bubble_s,
         CASE WHEN -gap >= 0 THEN 'green' ELSE 'red' END AS color
       FROM uniq u JOIN scale s ON u.property_id = s.property_id""", *_REPORT))
def chart_feed(spark, sf_dir):
    """impact, confidence, size and colour of the report's bubbles."""
    topics = rp.rank_topics(rp.topic_gaps(*d.source_comparison(spark, sf_dir)), 4)
    return rp.bubble_feed(topics).select("property_id", "topic", *_six("impact_x", "confidence_y", "bubble_s"), "color")


@query(with_sql(
    """asked AS (SELECT DISTINCT source AS property_id, unnest(['verb forms', 'words', 'wifi']) AS term FROM documents),
       resolved AS (SELECT *, CASE term WHEN 'wifi' THEN 'wifi and internet quality' ELSE term END AS matched_topic FROM asked)
       SELECT property_id, term, matched_topic, kind, topic, target_rate AS target_negative_rate,
         neighbors_rate AS neighbors_negative_rate, gap AS negative_rate_gap FROM (
         SELECT r.*, kind, topic, target_rate, neighbors_rate, gap, row_number() OVER (PARTITION BY r.property_id, term
           ORDER BY CASE WHEN topic IS NULL THEN 1 ELSE 0 END, CASE kind WHEN 'weakness' THEN 0 ELSE 1 END, rank) AS n
         FROM resolved r LEFT JOIN ranked_topics t ON r.property_id = t.property_id AND contains(t.topic, matched_topic))
       WHERE n = 1""", *_REPORT))
def focus_topics(spark, sf_dir):
    """The reported topic a question is about, per property and question."""
    topics = rp.rank_topics(rp.topic_gaps(*d.source_comparison(spark, sf_dir)), 4)
    asked = (
        table(spark, sf_dir, "documents").select(F.col("source").alias("property_id")).distinct()
        .select("property_id", F.explode(tx.word_array(["verb forms", "words", "wifi"])).alias("term"))
    )
    return rp.focus_topic(topics, asked).select(
        "property_id", "term", "matched_topic", "kind", "topic",
        "target_negative_rate", "neighbors_negative_rate", "negative_rate_gap",
    )


@query(with_sql(
    """pool AS (SELECT property_id, evidence_property_id, topic, sentence_id, topic_similarity, review_idx, sent_idx,
         sentiment_label, sentence_text FROM evidence WHERE topic IN ('endings', 'determiners'))
       SELECT property_id, topic AS term, topic AS matched_topic, position, evidence_property_id,
         CASE WHEN property_id = evidence_property_id THEN 'YOUR PROPERTY' ELSE 'NEIGHBOR' END AS source,
         upper(sentiment_label) AS sentiment, substr(sentence_text, 1, 300) AS quote
       FROM (SELECT *, CAST(row_number() OVER (PARTITION BY property_id, topic ORDER BY topic_similarity DESC,
         evidence_property_id, review_idx, sent_idx, sentence_id) AS INTEGER) AS position FROM pool) WHERE position <= 5""",
    *_REPORT, _EVIDENCE))
def evidence_lookup(spark, sf_dir):
    """X11: quotes about a topic, marked as own or as a neighbour's."""
    enriched, near = d.source_comparison(spark, sf_dir)
    evidence = rp.topic_evidence(enriched, near, 3)
    asked = near.select("property_id").distinct().select(
        "property_id", F.explode(tx.word_array(["endings", "determiners"])).alias("term")
    )
    return rp.evidence_for_terms(evidence, asked)


@query(with_sql(
    """lines AS (
         SELECT property_id, 'neighbors' AS section, rank AS position,
           '- Property ' || neighbor_property_id || printf(': %.2f%% similarity', similarity * 100) AS line FROM source_neighbours
         UNION ALL SELECT property_id, kind, position, '**' || array_to_string(list_transform(string_split(topic, ' '),
             lambda w: upper(w[1]) || w[2:]), ' ') || printf('** Your negative rate: %.1f%% | Neighbors: %.1f%% Gap: %s%.1f%% (you''re %s)',
             CAST(round(CAST(target_rate * 100 AS DECIMAL(18, 9)), 1) AS DOUBLE), CAST(round(CAST(neighbors_rate * 100 AS DECIMAL(18, 9)), 1) AS DOUBLE),
             CASE WHEN gap < 0 THEN '-' ELSE '+' END, CAST(round(CAST(abs(gap * 100) AS DECIMAL(18, 9)), 1) AS DOUBLE),
             CASE kind WHEN 'weakness' THEN 'worse' ELSE 'better' END)
         FROM (SELECT *, CAST(row_number() OVER (PARTITION BY property_id, kind ORDER BY abs(gap) DESC, rank, topic) AS INTEGER) AS position
               FROM ranked_topics) WHERE position <= 5)
       SELECT * FROM lines""", *_REPORT))
def report_lines(spark, sf_dir):
    """The readable report of every source."""
    enriched, near = d.source_comparison(spark, sf_dir)
    return pc.report_lines(rp.rank_topics(rp.topic_gaps(enriched, near), 4), near)


@query(with_sql(
    """rows AS (SELECT t.property_id, kind, t.topic, evidence_role, sentence_id, topic_similarity, sentiment_label, sentence_text
         FROM ranked_topics t JOIN evidence e ON t.property_id = e.property_id AND t.topic = e.topic)
       SELECT property_id, position, '[' || topic || '] (' || sentiment_label || '): "' || substr(sentence_text, 1, 200) || '..."' AS line FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY property_id ORDER BY topic_similarity DESC, topic, sentence_id, kind, evidence_role) AS INTEGER) AS position
         FROM rows) WHERE position <= 5""", *_REPORT, _EVIDENCE))
def evidence_lines(spark, sf_dir):
    """Five leading evidence lines per source."""
    enriched, near = d.source_comparison(spark, sf_dir)
    topics = rp.rank_topics(rp.topic_gaps(enriched, near), 4)
    return pc.evidence_lines(rp.evidence_of_topics(topics, rp.topic_evidence(enriched, near, 3)))


def _comparison(spark, sf_dir):
    """X9 from listings with reviews, run for all sources."""
    enriched, near = d.source_comparison(spark, sf_dir)
    topics = rp.rank_topics(rp.topic_gaps(enriched, near), 4)
    rows = d.source_sentences(spark, sf_dir)
    listings = d.source_listings(spark, sf_dir)
    return pc.Comparison(
        status=nb.neighbour_status(listings, listings.select("property_id"), k=5), neighbours=near,
        similarity=nb.similarity_stats(near), volume=st.sentence_volume(rows, near), topics=topics,
        evidence=rp.evidence_of_topics(topics, rp.topic_evidence(enriched, near, 3)), kept=[],
    )


@query(with_sql(
    """SELECT n.property_id, n.neighbors_selected_count, weaknesses, strengths, first_weakness FROM
         (SELECT property_id, count(*) AS neighbors_selected_count FROM source_neighbours GROUP BY property_id) n JOIN
         (SELECT property_id, CAST(count(*) FILTER (kind = 'weakness') AS BIGINT) AS weaknesses,
                 CAST(count(*) FILTER (kind = 'strength') AS BIGINT) AS strengths,
                 max(CASE WHEN kind = 'weakness' AND rank = 1 THEN topic END) AS first_weakness
          FROM ranked_topics GROUP BY property_id) t ON n.property_id = t.property_id""", *_REPORT))
def comparison_payloads(spark, sf_dir):
    """The nested JSON report of every source, read back by its main fields."""
    reports = pc.payloads(_comparison(spark, sf_dir))

    def size(path):
        return F.json_array_length(F.get_json_object("payload_json", path)).cast("bigint")

    return reports.select(
        "property_id", size("$.neighbors.neighbor_list").alias("neighbors_selected_count"),
        size("$.results.weaknesses_vs_neighbors").alias("weaknesses"),
        size("$.results.strengths_vs_neighbors").alias("strengths"),
        F.get_json_object("payload_json", "$.results.weaknesses_vs_neighbors[0].topic").alias("first_weakness"),
    )


_DOCUMENT_COMPARISON = rf"""
document_vectors AS (
  SELECT CAST(doc_id AS VARCHAR) AS property_id, source,
         [1, n_chars % 7, n_chars % 11, n_chars % 13, n_chars % 17]::DOUBLE[] AS vec FROM documents),
source_neighbours AS (
  SELECT property_id, neighbor_property_id FROM (
    SELECT a.property_id, b.property_id AS neighbor_property_id, row_number() OVER (PARTITION BY a.property_id
      ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.property_id) AS rank
    FROM document_vectors a JOIN document_vectors b ON a.source = b.source AND a.property_id <> b.property_id) WHERE rank <= 5),
tokenised AS (SELECT *, regexp_extract_all(lower(sentence_text), '([\p{{L}}\p{{N}}_]+)', 1) AS tokens FROM sentence_rows),
source_sentences AS (
  SELECT property_id, review_idx, sent_idx, sentence_id, sentence_text,
         CASE WHEN {_count_words(_POSITIVE)} > {_count_words(_NEGATIVE)} THEN 'positive'
              WHEN {_count_words(_POSITIVE)} < {_count_words(_NEGATIVE)} THEN 'negative' ELSE 'na' END AS sentiment_label
  FROM tokenised),
english_sentences AS (
  SELECT * FROM source_sentences WHERE regexp_matches(sentence_text, '[A-Za-z]')
    AND length(regexp_replace(sentence_text, '[\x00-\x7F]', '', 'g')) / CAST(greatest(length(sentence_text), 1) AS DOUBLE) <= 0.20)
"""


@query(with_sql(
    "SELECT property_id, kind, rank, topic, gap AS negative_rate_gap FROM ranked_topics WHERE rank <= 3",
    d.REVIEW_ROWS_SQL, d.SENTENCE_ROWS_SQL, _DOCUMENT_COMPARISON, d.ASSIGNMENTS_SQL, _GAPS))
def property_comparison(spark, sf_dir):
    """X9 end to end from listings: cells, neighbours, sentences, tagging, report, for all documents."""
    docs = costly(spark, sf_dir, "documents")
    vec = F.array(F.lit(1.0), *[F.pmod("n_chars", F.lit(m)).cast("double") for m in (7, 11, 13, 17)])
    listings = docs.select(
        F.col("doc_id").cast("string").alias("property_id"), F.to_json(F.split("text", "\n")).alias("reviews"),
        F.col("source").alias("geo_bucket"), F.lit(8).alias("geo_bucket_res"), F.col("source").alias("h3_8"),
        vec.alias("similarity_vec"),
    )
    comparison = pc.compare_properties(
        listings, pc.keyword_tagger(d.TOPIC_WORDS),
        lambda s: st.lexicon_sentiment(s, _POSITIVE, _NEGATIVE),
        params={"top_k_neighbors": 5, "top_k_weakness_topics": 3, "top_k_strength_topics": 3}, keep_sentences=False,
    )
    return comparison.topics.select("property_id", "kind", "rank", "topic", "negative_rate_gap")


# --- run tables ---------------------------------------------------------------------------------------

_FIRST, _SECOND = dt.datetime(2024, 5, 1, 8, 0), dt.datetime(2024, 5, 2, 9, 30)


def _written(spark, sf_dir, names=("neighbors", "topics", "evidence")):
    """Two runs appended to fresh run tables; the second has neighbours and topics of every source again."""
    base = shared_folder(spark, "runs")
    enriched, near = d.source_comparison(spark, sf_dir)
    topics = rp.rank_topics(rp.topic_gaps(enriched, near), 4)
    frames = {"neighbors": near, "topics": topics}
    if "evidence" in names:
        frames["evidence"] = rp.evidence_of_topics(topics, rp.topic_evidence(enriched, near, 3))
    wanted = {n: frames[n].persist() for n in names}
    tables.append_run(base, "run-1", wanted, _FIRST)
    tables.append_run(base, "run-2", {n: f for n, f in wanted.items() if n != "evidence"}, _SECOND)
    for frame in wanted.values():
        frame.unpersist()
    return base


@query(with_sql(
    """SELECT run_id, property_id, kind, topic, gap AS negative_rate_gap, target_n AS target_sentence_topic_assignments,
       run_date FROM ranked_topics, (VALUES ('run-1', '2024-05-01'), ('run-2', '2024-05-02')) v(run_id, run_date)""", *_REPORT))
def run_tables_written(spark, sf_dir):
    """Two runs appended, read back with their day."""
    df = tables.read_run_table(spark, _written(spark, sf_dir, ("topics",)), "topics")
    return df.select("run_id", "property_id", "kind", "topic", "negative_rate_gap", "target_sentence_topic_assignments", F.col("run_date").cast("string"))


@query(with_sql("SELECT 'run-2' AS run_id, property_id, kind, topic FROM ranked_topics", *_REPORT))
def latest_run_topics(spark, sf_dir):
    """The latest run of every property."""
    df = tables.read_run_table(spark, _written(spark, sf_dir, ("topics",)), "topics")
    return tables.latest_runs(df).select("run_id", "property_id", "kind", "topic")


@query(with_sql(
    """SELECT run_id, property_id, neighbor_property_id, round(similarity, 6) AS similarity FROM (
         SELECT 'run-2' AS run_id, property_id, neighbor_property_id, similarity,
           row_number() OVER (ORDER BY property_id, neighbor_property_id) AS n FROM source_neighbours) WHERE n <= 50
       """, d.SOURCE_NEIGHBOURS_SQL))
def newest_neighbours(spark, sf_dir):
    """The newest 50 neighbour rows when neither run nor property is asked for."""
    rows = tables.read_neighbours(spark, _written(spark, sf_dir, ("neighbors",)))
    return rows.select("run_id", "property_id", "neighbor_property_id", *_six("similarity"))


@query(with_sql(
    """SELECT 'run-2' AS run_id, property_id, kind, topic FROM (SELECT *, row_number() OVER (ORDER BY property_id, kind, topic) AS n
       FROM ranked_topics WHERE kind = 'weakness') WHERE n <= 20""", *_REPORT))
def newest_weaknesses(spark, sf_dir):
    """The newest 20 topics of one kind."""
    rows = tables.read_topics(spark, _written(spark, sf_dir, ("topics",)), kind="weakness")
    return rows.select("run_id", "property_id", "kind", "topic")


@query(with_sql(
    """SELECT t.property_id, kind, evidence_role, sentence_id, round(topic_similarity, 6) AS topic_similarity
       FROM ranked_topics t JOIN evidence e ON t.property_id = e.property_id AND t.topic = e.topic
       WHERE t.topic = 'endings' ORDER BY e.topic_similarity DESC, sentence_id, kind, evidence_role, t.property_id LIMIT 10""", *_REPORT, _EVIDENCE))
def evidence_by_topic(spark, sf_dir):
    """The best ten evidence rows of a run about a topic."""
    rows = tables.read_evidence(spark, _written(spark, sf_dir, ("topics", "evidence")), "run-1", "endings")
    return rows.select("property_id", "kind", "evidence_role", "sentence_id", *_six("topic_similarity"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS property_id, 'error' AS status, substr('no cell for ' || text, 1, 2000) AS error_message,
          true AS nothing_else FROM documents""")
def error_runs(spark, sf_dir):
    """A failed run per listing as rows of the full schema, messages cut to 2000 characters."""
    base = shared_folder(spark, "runs")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("property_id"), F.lit("error").alias("status"),
        tx.cap(F.concat(F.lit("no cell for "), "text"), ERROR_MESSAGE_CHARS).alias("error_message"),
    )
    tables.append_run(base, "run-e", {"runs": rows}, _FIRST)
    return tables.read_run_table(spark, base, "runs").select(
        "property_id", "status", "error_message",
        (F.col("payload_json").isNull() & F.col("neighbors_selected_count").isNull()).alias("nothing_else"),
    )
