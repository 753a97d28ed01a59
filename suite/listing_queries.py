"""Documents, retrieval, rankings, features and the rating regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.functions import ids
from innsight.functions import text as tx
from innsight.functions.reviews import split_reviews
from innsight.fixed_values import CATEGORY_RATINGS, GLOBAL_AMENITIES
from innsight.operators import cell_models as cm
from innsight.operators import documents as dc
from innsight.operators import explain as ex
from innsight.operators import features as ft
from innsight.operators import retrieval as rt
from innsight.operators import topics as tp
from innsight.operators import vector_index as vi
from innsight.plans import ingestion, rating_insights as ri
from innsight.sources import tables
from innsight.sources.shared import shared_folder
from suite import derive as d
from suite.derive import costly, table, with_sql
from suite.registry import query


def _six(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


# --- documents ----------------------------------------------------------------------------------

@query(with_sql("SELECT * FROM booking_hotel_documents", d.BOOKING_HOTELS_SQL))
def booking_hotel_documents(spark, sf_dir):
    """Booking hotels as documents, defaults for missing texts."""
    return dc.booking_hotel_documents(d.booking_hotels(spark, sf_dir))


@query(with_sql("SELECT * FROM booking_review_documents", d.BOOKING_HOTELS_SQL))
def booking_review_documents(spark, sf_dir):
    """One document per booking review, gaps kept."""
    return dc.booking_review_documents(d.booking_hotels(spark, sf_dir))


@query(with_sql("SELECT * FROM airbnb_hotel_documents", d.AIRBNB_LISTINGS_SQL))
def airbnb_hotel_documents(spark, sf_dir):
    """Airbnb listings as documents, ratings with commas, surrogate ids."""
    return dc.airbnb_hotel_documents(d.airbnb_listings(spark, sf_dir))


@query(with_sql("SELECT * FROM airbnb_review_documents", d.AIRBNB_LISTINGS_SQL))
def airbnb_review_documents(spark, sf_dir):
    """One document per parsed airbnb review of ten characters or more."""
    return dc.airbnb_review_documents(d.airbnb_listings(spark, sf_dir))


@query(with_sql(
    """SELECT text_id, CAST(len(reviews) AS INTEGER) AS n_reviews, sha256(array_to_string(reviews, chr(30))) AS digest
       FROM (SELECT form || ':' || sha256(text) AS text_id, reviews FROM airbnb_reviews)""", d.AIRBNB_LISTINGS_SQL))
def parsed_reviews(spark, sf_dir):
    """P5: the ladder over eight forms of review strings."""
    listings = d.airbnb_listings(spark, sf_dir, ("form", "text"))
    parsed = listings.withColumn("parts", split_reviews(F.col("reviews")))
    return parsed.select(
        F.concat_ws(":", F.col("form").cast("string"), F.sha2("text", 256)).alias("text_id"),
        F.size("parts").alias("n_reviews"), F.sha2(F.array_join("parts", "\u001e"), 256).alias("digest"),
    )


@query(with_sql(
    """SELECT namespace, count(*) AS documents, count(DISTINCT hotel_id) AS hotels FROM corpus GROUP BY namespace""", d.CORPUS_SQL))
def documents_union(spark, sf_dir):
    """All documents as one corpus, counted per namespace."""
    return dc.namespace_summary(d.corpus(spark, sf_dir))


@query(with_sql(
    """SELECT doc_id, regexp_replace(hotel_id, 'ABB_|BKG_', '', 'g') AS raw_id,
       CASE WHEN starts_with(hotel_id, 'ABB_') THEN 'airbnb' WHEN starts_with(hotel_id, 'BKG_') THEN 'booking' ELSE 'unknown' END AS source,
       starts_with(hotel_id, 'ABB_') AS is_airbnb FROM (SELECT doc_id, hotel_id FROM corpus UNION ALL SELECT doc_id, 'X_' || original_id FROM corpus)""",
    d.CORPUS_SQL))
def id_prefixes(spark, sf_dir):
    """Raw id and source out of prefixed ids, also for unknown prefixes."""
    docs = d.corpus(spark, sf_dir)
    both = docs.select("doc_id", F.explode(F.array("hotel_id", F.concat(F.lit("X_"), "original_id"))).alias("hotel_id"))
    hotel = F.col("hotel_id")
    return both.select(
        "doc_id", ids.raw_id(hotel).alias("raw_id"), ids.source_of(hotel).alias("source"), ids.is_airbnb(hotel).alias("is_airbnb")
    )


@query(with_sql(
    """SELECT namespace, doc_id FROM corpus WHERE (source = 'booking' AND city = 'src3') OR (source = 'airbnb' AND contains(city, 'src3'))""",
    d.CORPUS_SQL))
def city_documents(spark, sf_dir):
    """One city's documents, by equality for booking and by part of the location for airbnb."""
    return ingestion.build_corpus(
        d.booking_hotels(spark, sf_dir), d.airbnb_listings(spark, sf_dir), city="src3"
    ).select("namespace", "doc_id")


@query(with_sql(
    """SELECT doc_id FROM booking_hotel_documents JOIN (SELECT hotel_id AS h FROM booking_hotels ORDER BY hotel_id LIMIT 5)
       ON original_id = CAST(h AS VARCHAR)""", d.BOOKING_HOTELS_SQL))
def first_hotels(spark, sf_dir):
    """T4: the first five hotels of a source."""
    return dc.booking_hotel_documents(d.booking_hotels(spark, sf_dir), limit=5).select("doc_id")


@query("""SELECT 'documents' AS source, count(*) AS rows FROM documents UNION ALL SELECT 'customer', count(*) FROM customer""")
def source_rows(spark, sf_dir):
    """Rows per source after loading."""
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return tables.source_counts({
        "documents": tables.read_table(spark, f"{sf_dir}/documents.parquet"),
        "customer": tables.read_table(spark, f"{sf_dir}/customer.parquet", schema=schema),
    })


@query(with_sql(
    """versions AS (
         SELECT namespace, doc_id, text, CAST(1 AS BIGINT) AS version FROM corpus WHERE namespace <> 'booking_reviews'
         UNION ALL SELECT namespace, doc_id, 'new ' || text, CAST(2 AS BIGINT) FROM corpus
         WHERE namespace <> 'booking_reviews' AND (country = 'de' OR contains(city, 'src1')))
       SELECT namespace, doc_id, text, version FROM (
         SELECT *, row_number() OVER (PARTITION BY namespace, doc_id ORDER BY version DESC, text) AS n FROM versions) WHERE n = 1""",
    d.CORPUS_SQL))
def upserted_documents(spark, sf_dir):
    """A second version of some documents of all namespaces merged into the table, one namespace dropped."""
    path = shared_folder(spark, "corpus")
    docs = d.corpus(spark, sf_dir)
    tables.upsert_documents(spark, path, docs, version=1)
    changed = docs.filter((F.col("country") == "de") | F.contains("city", F.lit("src1")))
    tables.upsert_documents(spark, path, changed.withColumn("text", F.concat(F.lit("new "), "text")), version=2)
    tables.drop_namespaces(spark, path, ["booking_reviews"])
    return tables.read_documents(spark, path).select("namespace", "doc_id", "text", "version")


@query(with_sql(
    """SELECT namespace, count(*) AS documents, count(DISTINCT hotel_id) AS hotels FROM (
         SELECT *, row_number() OVER (PARTITION BY namespace, doc_id) AS n FROM corpus) WHERE n = 1 GROUP BY namespace""", d.CORPUS_SQL))
def ingestion_summary(spark, sf_dir):
    """The whole ingestion into a document table, counted per namespace."""
    path = shared_folder(spark, "corpus")
    return ingestion.ingest(spark, path, d.booking_hotels(spark, sf_dir), d.airbnb_listings(spark, sf_dir), version=1)


# --- retrieval ------------------------------------------------------------------------------------

_CORPUS_VECTORS = r"""
vector_queries AS (SELECT CAST(min(vec_id) AS VARCHAR) AS query_id, label FROM embeddings GROUP BY label),
query_vectors AS (SELECT query_id, q.label, CAST(embedding AS DOUBLE[]) AS vec FROM vector_queries q JOIN embeddings ON CAST(vec_id AS VARCHAR) = query_id)
"""


def _vector_queries(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").cast("string").alias("query_id"))
    corpus = e.select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return first, corpus


@query(with_sql(
    """SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank FROM (
         SELECT query_id, CAST(vec_id AS VARCHAR) AS doc_id, round(list_cosine_similarity(vec, CAST(embedding AS DOUBLE[])), 9) AS similarity,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vec, CAST(embedding AS DOUBLE[])), 9) DESC,
             CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM query_vectors, embeddings) WHERE rank <= 5""", _CORPUS_VECTORS))
def vector_search(spark, sf_dir):
    """The five nearest documents of each query over the whole corpus."""
    queries, corpus = _vector_queries(spark, sf_dir)
    return rt.search_top_k(queries, corpus, 5).select("query_id", "doc_id", *_six("similarity"), "rank")


@query(with_sql(
    """SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank FROM (
         SELECT query_id, CAST(vec_id AS VARCHAR) AS doc_id, round(list_cosine_similarity(vec, CAST(embedding AS DOUBLE[])), 9) AS similarity,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vec, CAST(embedding AS DOUBLE[])), 9) DESC,
             CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM query_vectors q JOIN embeddings e ON q.label = e.label) WHERE rank <= 5""", _CORPUS_VECTORS))
def vector_search_filtered(spark, sf_dir):
    """R1 with a metadata filter: only documents of the query's own label."""
    queries, corpus = _vector_queries(spark, sf_dir)
    return rt.search_top_k(queries, corpus, 5, ["label"]).select("query_id", "doc_id", *_six("similarity"), "rank")


@query()
def vector_search_indexed(spark, sf_dir):
    """R1 approximate: every fiftieth vector against an index of all, written and read back."""
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    path = shared_folder(spark, "vector-index")
    vi.write_index(corpus, path, id_col="vec_id")
    queries = corpus.where("vec_id % 50 = 0").withColumn("query_id", F.col("vec_id").cast("string"))
    return vi.search_index(queries, path, 10).select("query_id", "doc_id", *_six("similarity"), "rank")


@query("""
WITH near AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS query_id, e.label, CAST(row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, CAST(e.vec_id AS VARCHAR)) AS INTEGER) AS rank,
    CAST(e.vec_id AS VARCHAR) AS doc_id, round(round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9), 6) AS similarity
  FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id % 50 = 0)
SELECT query_id, doc_id, similarity, rank FROM near WHERE rank <= 3
""")
def vector_search_all_buckets(spark, sf_dir):
    """The index with a filter and all buckets probed, which is the exact result."""
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    path = shared_folder(spark, "vector-index")
    vi.write_index(corpus, path, ["label"], tables=2, bits=3, id_col="vec_id")
    queries = corpus.where("vec_id % 50 = 0").withColumn("query_id", F.col("vec_id").cast("string"))
    return vi.search_index(queries, path, 3, probes=8).select("query_id", "doc_id", *_six("similarity"), "rank")


_LANG_WORDS = ("the", "der", "que", "les")
_REVIEW_VECTORS_SQL = f"""
review_vectors AS (
  SELECT namespace, doc_id, CASE WHEN right(hotel_id, 1) IN ('0', '2', '4', '6', '8') THEN replace(hotel_id, 'ABB_', 'X_') ELSE hotel_id END AS hotel_id, text,
    [{', '.join(f"1.0 + len(regexp_extract_all(text, '{w}'))" for w in _LANG_WORDS)}]::DOUBLE[] AS vec
  FROM corpus WHERE namespace IN ('booking_reviews', 'airbnb_reviews')),
review_asked AS (
  SELECT DISTINCT hotel_id AS query_id, hotel_id, [2.0, 1.0, 1.0, 1.0]::DOUBLE[] AS q FROM review_vectors)
"""


def _review_vectors(spark, sf_dir):
    docs = d.corpus(spark, sf_dir).filter(F.col("namespace").endswith("_reviews"))
    vec = F.array(*[F.lit(1.0) + F.regexp_count("text", F.lit(w)) for w in _LANG_WORDS])
    # half of the airbnb hotels under a prefix that is not known, so that the second place is reached
    hotel = F.when(F.right("hotel_id", F.lit(1)).isin("0", "2", "4", "6", "8"), F.replace("hotel_id", F.lit("ABB_"), F.lit("X_")))
    return docs.select("namespace", "doc_id", F.coalesce(hotel, "hotel_id").alias("hotel_id"), "text", vec.alias("vector"))


@query(with_sql(
    """SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank FROM (
         SELECT query_id, doc_id, round(list_cosine_similarity(q, vec), 9) AS similarity, CAST(row_number() OVER (PARTITION BY query_id
           ORDER BY round(list_cosine_similarity(q, vec), 9) DESC, doc_id) AS INTEGER) AS rank
         FROM review_asked a JOIN review_vectors v ON a.hotel_id = v.hotel_id) WHERE rank <= 3""", d.CORPUS_SQL, _REVIEW_VECTORS_SQL))
def hotel_reviews(spark, sf_dir):
    """Reviews of every hotel nearest to a query, the place chosen by the prefix or found in the second."""
    # requests, their places and the search read them: parsed once
    reviews = d.stored(_review_vectors(spark, sf_dir).drop("text"), "review-vectors")
    asked = reviews.select("hotel_id").distinct().select(
        F.col("hotel_id").alias("query_id"), "hotel_id", F.array(*[F.lit(x) for x in (2.0, 1.0, 1.0, 1.0)]).alias("vector")
    )
    return rt.hotel_reviews(asked, reviews, 3).select("query_id", "doc_id", *_six("similarity"), "rank")


@query(with_sql(
    """asked AS (SELECT DISTINCT 'BKG_' || hotel_id AS hotel_id FROM booking_hotels UNION SELECT DISTINCT 'BKG_0' || city FROM booking_hotels),
       named AS (SELECT hotel_id, CASE WHEN starts_with(hotel_id, 'BKG_0src') THEN 'hotel ' || substr(hotel_id, 6) || ' ' ELSE 'none' END AS hotel_name FROM asked),
       by_id AS (SELECT n.hotel_id, d.hotel_id AS found_hotel_id, 'id' AS found_by FROM named n JOIN booking_hotel_documents d ON n.hotel_id = d.hotel_id),
       by_name AS (SELECT n.hotel_id, min(d.hotel_id) AS found_hotel_id, 'name' AS found_by FROM named n JOIN booking_hotel_documents d
         ON contains(lower(d.title), n.hotel_name) WHERE n.hotel_id NOT IN (SELECT hotel_id FROM by_id) GROUP BY n.hotel_id)
       SELECT n.hotel_id, f.found_hotel_id, f.found_by FROM named n LEFT JOIN (SELECT * FROM by_id UNION ALL SELECT * FROM by_name) f ON n.hotel_id = f.hotel_id""",
    d.BOOKING_HOTELS_SQL))
def hotel_lookup(spark, sf_dir):
    """R2: every hotel by its id, and one unknown id per city by the name."""
    hotels = d.booking_hotels(spark, sf_dir)
    known = hotels.select(ids.prefixed("BKG", F.col("hotel_id")).alias("hotel_id"), F.lit("none").alias("hotel_name"))
    unknown = hotels.select("city").distinct().select(
        F.concat(F.lit("BKG_0"), "city").alias("hotel_id"), F.concat(F.lit("hotel "), "city", F.lit(" ")).alias("hotel_name")
    )
    found = rt.lookup_hotels(known.unionByName(unknown), dc.booking_hotel_documents(hotels))
    return found.select("hotel_id", "found_hotel_id", "found_by")


@query(with_sql(
    """hotels AS (SELECT DISTINCT hotel_id, title, city, 0 AS place FROM booking_hotel_documents UNION ALL
         SELECT DISTINCT hotel_id, title, replace(city, ' centre', ''), 1 FROM airbnb_hotel_documents)
       SELECT hotel_id, position, competitor_id, competitor, source FROM (
         SELECT a.hotel_id, h.hotel_id AS competitor_id, h.title AS competitor, CASE place WHEN 0 THEN 'Booking.com' ELSE 'Airbnb' END AS source,
           CAST(row_number() OVER (PARTITION BY a.hotel_id ORDER BY place, h.hotel_id) AS INTEGER) AS position
         FROM (SELECT hotel_id, title, city FROM hotels) a JOIN hotels h ON a.city = h.city
         WHERE NOT contains(lower(h.title), lower(a.title))) WHERE position <= 5""", d.CORPUS_SQL))
def same_city_competitors(spark, sf_dir):
    """Five competitors of the same city for every hotel of both sources."""
    docs = d.corpus(spark, sf_dir).filter(F.col("namespace").endswith("_hotels")).withColumn(
        "city", F.replace("city", F.lit(" centre"), F.lit(""))
    ).dropDuplicates(["namespace", "hotel_id"])
    asked = docs.select("hotel_id", F.col("title").alias("hotel_name"), "city")
    return rt.city_competitors(asked, docs, 5, shortlist=8)


_SUPPLIER_HOTELS_SQL = r"""
supplier_hotels AS (
  SELECT 'ABB_' || s_suppkey AS hotel_id, s_name AS title,
         CASE WHEN s_nationkey < 5 THEN CAST(s_nationkey AS DOUBLE) END AS meta_rating,
         CASE WHEN s_nationkey < 5 THEN '$' || CAST(s_suppkey AS VARCHAR) || ',000.5' END AS meta_price,
         CASE WHEN s_nationkey < 20 THEN 'A place. Score: ' || CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 50 / 10.0::DOUBLE AS VARCHAR)
              || '. price  $' || CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS VARCHAR) || '.25 a night' ELSE 'No numbers here' END AS text
  FROM supplier),
metrics AS (
  SELECT hotel_id, title,
    coalesce(CASE WHEN meta_rating <> 0 THEN meta_rating END, try_cast(regexp_extract(text, '(?i)(?:Rating|Score)[:\s]+(\d+\.?\d*)', 1) AS DOUBLE)) AS rating,
    coalesce(try_cast(regexp_replace(meta_price, '[$,]', '', 'g') AS DOUBLE),
             try_cast(regexp_extract(text, '(?i)(?:Price|Rate)[:\s]+[\$]?(\d+(?:\.\d{2})?)', 1) AS DOUBLE)) AS price
  FROM supplier_hotels)
"""


def _metrics(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    whole = F.floor(F.abs("s_acctbal")).cast("bigint")
    text = F.when(
        F.col("s_nationkey") < 20,
        F.concat(F.lit("A place. Score: "), (F.pmod(whole, F.lit(50)) / F.lit(10.0)).cast("string"),
                 F.lit(". price  $"), whole.cast("string"), F.lit(".25 a night")),
    ).otherwise("No numbers here")
    hotels = s.select(
        ids.prefixed("ABB", F.col("s_suppkey")).alias("hotel_id"), F.col("s_name").alias("title"),
        F.when(F.col("s_nationkey") < 5, F.col("s_nationkey").cast("double")).alias("meta_rating"),
        F.when(F.col("s_nationkey") < 5, F.concat(F.lit("$"), F.col("s_suppkey").cast("string"), F.lit(",000.5"))).alias("meta_price"),
        text.alias("text"),
    )
    return hotels.select(
        "hotel_id", "title", rt.rating_metric(F.col("meta_rating"), F.col("text")).alias("rating"),
        rt.price_metric(F.col("meta_price"), F.col("text")).alias("price"),
    )


@query(with_sql("SELECT hotel_id, title, rating, price FROM metrics", _SUPPLIER_HOTELS_SQL))
def hotel_metrics(spark, sf_dir):
    """rating and price from the metadata, else from the text."""
    return _metrics(spark, sf_dir)


@query(with_sql(
    """SELECT CAST(row_number() OVER (ORDER BY value DESC, hotel_id) AS INTEGER) AS position, hotel_id, title, value,
       contains(lower(title), 'supplier#00000001') AS is_mine FROM (SELECT hotel_id, title, rating AS value FROM metrics
       WHERE rating IS NOT NULL ORDER BY rating DESC, hotel_id LIMIT 10)""", _SUPPLIER_HOTELS_SQL))
def metric_rank(spark, sf_dir):
    """The ten best hotels by rating, the own one marked."""
    return rt.rank_by_metric(_metrics(spark, sf_dir).withColumnRenamed("rating", "value"), "rating", 10, "Supplier#00000001")


@query(with_sql(
    """SELECT CAST(row_number() OVER (ORDER BY value, hotel_id) AS INTEGER) AS position, hotel_id, title, value, false AS is_mine
       FROM (SELECT hotel_id, title, price AS value FROM metrics WHERE price IS NOT NULL ORDER BY price, hotel_id LIMIT 10)""", _SUPPLIER_HOTELS_SQL))
def price_rank(spark, sf_dir):
    """T7 R5 by price, cheapest first."""
    return rt.rank_by_metric(_metrics(spark, sf_dir).withColumnRenamed("price", "value"), "price", 10)


_TOPIC_QUESTIONS = ["endings tion", "who speaks german nicht", "wifi speed", "the staff"]
_QUESTION_GROUPS = {"endings": ["tion", "ing"], "german": ["nicht", "und"], "wifi": ["wifi", "signal", "speed"], "staff": ["staff", "service"]}
_QUESTION_WORDS_SQL = r"""
questions AS (SELECT * FROM (VALUES
  ('endings tion', ['tion', 'ing', 'endings']), ('who speaks german nicht', ['nicht', 'und', 'who', 'speaks', 'german']),
  ('wifi speed', ['wifi', 'signal', 'speed']), ('the staff', ['staff', 'service', 'the'])) v(query, keywords)),
asked_reviews AS (
  SELECT query, keywords, d.doc_id, source, text,
    len(list_filter(keywords, lambda k: contains(lower(text), k))) > 0 AS relevant FROM documents d, questions)
"""


def _asked_reviews(spark, sf_dir):
    questions = tp.query_keywords(
        spark.createDataFrame([(q,) for q in _TOPIC_QUESTIONS], "query string"), groups=_QUESTION_GROUPS
    ).collect()
    asked = F.array(
        *[F.struct(F.lit(q["query"]).alias("query"), tx.word_array(q["keywords"]).alias("keywords")) for q in questions]
    )
    return costly(spark, sf_dir, "documents").select("doc_id", "source", "text", F.inline(asked))


@query(with_sql("SELECT query, doc_id, relevant FROM asked_reviews", _QUESTION_WORDS_SQL))
def topic_relevance(spark, sf_dir):
    """Whether a review mentions what a question is about, for all reviews."""
    asked = _asked_reviews(spark, sf_dir)
    return asked.select("query", "doc_id", tp.mentions_keyword(F.col("text"), F.col("keywords")).alias("relevant"))


@query(with_sql(
    """numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query, source, relevant ORDER BY doc_id) AS INTEGER) AS position,
         CAST(sum(CAST(relevant AS INTEGER)) OVER (PARTITION BY query, source) AS BIGINT) AS n_relevant FROM asked_reviews)
       SELECT query, source, doc_id, relevant, position, n_relevant FROM numbered
       WHERE (relevant AND position <= 8) OR (NOT relevant AND position <= 3 AND n_relevant < 3)""", _QUESTION_WORDS_SQL))
def relevant_reviews(spark, sf_dir):
    """Per source and question eight relevant reviews, or others where there are few."""
    asked = _asked_reviews(spark, sf_dir)
    shown = rt.split_by_topic(asked, keys=("query", "source"), order=("doc_id",))
    return shown.select("query", "source", "doc_id", "relevant", "position", "n_relevant")


@query(with_sql(
    """counts AS (SELECT property_id AS hotel_id, topic, count(*) FILTER (sentiment_label = 'positive') AS positive,
         count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) AS reviews FROM enriched GROUP BY ALL)
       SELECT *, CASE WHEN positive > 2 * negative THEN 'Positive' WHEN negative > 2 * positive THEN 'Negative' ELSE 'Mixed' END AS overall
       FROM counts""", d.SOURCE_SENTENCES_SQL, d.ASSIGNMENTS_SQL))
def sentiment_digest(spark, sf_dir):
    """Labels per hotel and topic, and the overall impression."""
    from innsight.plans.property_comparison import keyword_tagger

    enriched = keyword_tagger(d.TOPIC_WORDS)(d.source_sentences(spark, sf_dir))
    return rt.sentiment_digest(enriched.withColumnRenamed("property_id", "hotel_id"))


_BUDGETS = {"routing": (500, "..."), "conversation": (800, "..."), "intermediate": (1000, "..."), "query": (3000, "\n... [context truncated]")}


@query("SELECT doc_id, " + ", ".join(
    f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '{mark}' ELSE text END AS {name}".replace("\n", "' || chr(10) || '")
    for name, (n, mark) in _BUDGETS.items()) + """,
    CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '... [truncated ' || (length(text) - 2000) || ' chars]' ELSE text END AS tool
    FROM documents""")
def text_budgets(spark, sf_dir):
    """texts cut to the five character budgets with their marks."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", *[F.col("text").alias(n) for n in _BUDGETS], tx.cap_with_count(F.col("text"), 2000).alias("tool")
    )
    return rt.capped_text(docs, _BUDGETS)


# --- features ---------------------------------------------------------------------------------------

def _features(spark, sf_dir):
    return ft.listing_features(d.feature_listings(spark, sf_dir, amenities=False), ft.fx_rates(spark))


@query(with_sql(
    """SELECT property_id, currency, guests, round(price * to_usd, 6) AS price_usd, round(price * to_usd / guests, 6) AS price_per_guest,
       is_super_host, ratings FROM feature_listings""", d.FEATURE_LISTINGS_SQL))
def price_features(spark, sf_dir):
    """Prices in USD and per guest, unknown currencies and guests handled."""
    return _features(spark, sf_dir).select(
        "property_id", "currency", "guests", *_six("price_usd", "price_per_guest"), "is_super_host", "ratings"
    )


@query(with_sql("SELECT property_id, cancellation_bucket, cat_cleanliness, cat_checkin, cat_communication FROM feature_listings", d.FEATURE_LISTINGS_SQL))
def category_features(spark, sf_dir):
    """Cancellation buckets and category ratings."""
    return _features(spark, sf_dir).select("property_id", "cancellation_bucket", "cat_cleanliness", "cat_checkin", "cat_communication")


@query(with_sql("SELECT property_id, name FROM amenity_items", d.FEATURE_LISTINGS_SQL))
def amenity_items(spark, sf_dir):
    """Named amenities of the JSON, variants merged."""
    return ft.amenity_items(d.feature_listings(spark, sf_dir))


@query(with_sql(
    """SELECT name, count(*) AS count FROM amenity_items GROUP BY name ORDER BY count(*) DESC, name LIMIT 20""", d.FEATURE_LISTINGS_SQL))
def amenity_topk(spark, sf_dir):
    """A5: the 20 most frequent amenities."""
    return ft.top_amenities(ft.amenity_items(d.feature_listings(spark, sf_dir)), 20)


_CHOSEN = r"""
chosen AS (SELECT DISTINCT name FROM (
  (SELECT name FROM amenity_items GROUP BY name ORDER BY count(*) DESC, name LIMIT 20) UNION ALL
  SELECT unnest(['wifi', 'air conditioning', 'heating', 'washer', 'dryer', 'free parking on premises', 'pool', 'hot tub', 'kitchen', 'tv', 'hair dryer']))),
flags AS (
  SELECT l.property_id, 'amen_' || replace(replace(c.name, ' ', '_'), '-', '_') AS feature,
         CAST(i.name IS NOT NULL AS DOUBLE) AS value
  FROM feature_listings l CROSS JOIN chosen c LEFT JOIN (SELECT DISTINCT property_id, name FROM amenity_items) i
    ON l.property_id = i.property_id AND c.name = i.name)
"""


@query(with_sql("SELECT property_id, feature, value FROM flags", d.FEATURE_LISTINGS_SQL, _CHOSEN))
def amenity_onehot(spark, sf_dir):
    """Flags of frequent and fixed amenities, back on all listings, in long form."""
    df, columns = ft.with_amenities(d.feature_listings(spark, sf_dir), 20)
    return ft.long_features(df, columns)


@query("""SELECT p_partkey AS property_id, unnest(['p_size', 'p_retailprice']) AS feature,
          unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS value FROM part""")
def unpivot_features(spark, sf_dir):
    """wide rows to feature and value."""
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "property_id")
    return ft.long_features(parts, ["p_size", "p_retailprice"])


@query(with_sql(
    """thresholds AS (SELECT country, quantile_disc(ratings, 0.8) AS threshold FROM feature_listings WHERE ratings IS NOT NULL GROUP BY country),
       top AS (SELECT l.*, threshold FROM feature_listings l JOIN thresholds t ON l.country = t.country WHERE ratings >= threshold),
       modes AS (SELECT country, cancellation_bucket FROM (SELECT country, cancellation_bucket, row_number() OVER (PARTITION BY country
         ORDER BY count(*) DESC, cancellation_bucket) AS n FROM top GROUP BY country, cancellation_bucket) WHERE n = 1)
       SELECT t.country, threshold, count(*) AS n_benchmark, round(avg(price * to_usd / guests), 6) AS price_per_guest,
         round(avg(cat_cleanliness), 6) AS cat_cleanliness, round(avg(is_super_host), 6) AS is_super_host, m.cancellation_bucket
       FROM top t JOIN modes m ON t.country = m.country GROUP BY ALL""", d.FEATURE_LISTINGS_SQL))
def top_quintile_means(spark, sf_dir):
    """Means and modes of the top fifth by rating, per country."""
    train = ex.training_rows(_features(spark, sf_dir))
    numerics = ["price_per_guest", "cat_cleanliness", "is_super_host"]
    top = ex.benchmark(train, "ratings", numerics, ["cancellation_bucket"], ["country"])
    return top.select("country", "threshold", "n_benchmark", *_six(*numerics), "cancellation_bucket")


_SHARE_SQL = r"""
supplier_features AS (
  SELECT l_suppkey AS property_id, l_returnflag || l_linestatus AS feature, round(avg(l_quantity) - 25, 9) AS target_scaled,
         round(max(l_discount), 9) AS top_scaled FROM lineitem GROUP BY ALL),
coefs AS (SELECT * FROM (VALUES ('AF', 0.5::DOUBLE), ('AO', -0.25::DOUBLE), ('NF', 0.0::DOUBLE), ('NO', 1.5::DOUBLE), ('RF', -1.0::DOUBLE), ('RO', 0.125::DOUBLE)) v(feature, coef)),
effects AS (
  SELECT f.*, coef, coef * target_scaled AS impact_value, abs(coef * target_scaled) AS abs_impact,
         coef * (top_scaled - target_scaled) AS potential_gain_scaled FROM supplier_features f JOIN coefs c ON f.feature = c.feature),
totals AS (SELECT property_id, sum(abs_impact) AS total FROM effects GROUP BY property_id)
"""


def _shares(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    coefs = spark.createDataFrame(
        [("AF", 0.5), ("AO", -0.25), ("NF", 0.0), ("NO", 1.5), ("RF", -1.0), ("RO", 0.125)], "feature string, coef double"
    )
    values = lines.groupBy(
        F.col("l_suppkey").alias("property_id"), F.concat("l_returnflag", "l_linestatus").alias("feature")
    ).agg(F.round(F.avg("l_quantity") - 25, 9).alias("target_scaled"), F.round(F.max("l_discount"), 9).alias("top_scaled"))
    return ex.insight_share(values.join(coefs, "feature"))


@query(with_sql(
    """SELECT e.property_id, feature, round(impact_value, 6) + 0.0 AS impact_value, round(potential_gain_scaled, 6) + 0.0 AS potential_gain_scaled,
       round(abs_impact / CASE WHEN total = 0 THEN 1 ELSE total END * 100, 4) AS impact_pct_abs,
       CASE WHEN coef > 0 THEN 'Positive (Good to have)' WHEN coef < 0 THEN 'Negative (Avoid)' ELSE 'Neutral' END AS market_trend
       FROM effects e JOIN totals t ON e.property_id = t.property_id""", _SHARE_SQL))
def insight_share(spark, sf_dir):
    """Impact, gain, share and trend of given features per supplier."""
    shares = _shares(spark, sf_dir)
    return shares.select(
        "property_id", "feature", *_six("impact_value", "potential_gain_scaled"),
        F.round("impact_pct_abs", 4).alias("impact_pct_abs"), "market_trend",
    )


@query(with_sql(
    """SELECT property_id, position, feature, upper(feature[1]) || lower(feature[2:]) AS feature_label, round(opportunity, 6) AS opportunity FROM (
         SELECT property_id, feature, potential_gain_scaled AS opportunity, CAST(row_number() OVER (PARTITION BY property_id
           ORDER BY potential_gain_scaled DESC, feature) AS INTEGER) AS position FROM effects WHERE potential_gain_scaled > 0.01)
       WHERE position <= 3""", _SHARE_SQL))
def gain_feed(spark, sf_dir):
    """The largest gains per supplier with readable labels."""
    shares = _shares(spark, sf_dir).select(
        "property_id", F.col("feature").alias("name"), F.col("potential_gain_scaled").alias("opportunity")
    )
    return ex.gain_feed(shares, 3).withColumn("opportunity", F.round("opportunity", 6))


@query(with_sql(
    """shares AS (
         SELECT e.property_id, feature, round(abs_impact / CASE WHEN total = 0 THEN 1 ELSE total END * 100, 6) + 0.0 AS importance_pct
         FROM effects e JOIN totals t ON e.property_id = t.property_id)
       SELECT property_id, position, feature, upper(feature[1]) || lower(feature[2:]) AS feature_label, importance_pct FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY property_id ORDER BY importance_pct DESC, feature) AS INTEGER) AS position FROM shares)
       WHERE position <= 4""", _SHARE_SQL))
def impact_feed(spark, sf_dir):
    """The strongest effects per supplier with readable labels."""
    shares = _shares(spark, sf_dir).select(
        "property_id", F.col("feature").alias("name"), (F.round("impact_pct_abs", 6) + F.lit(0.0)).alias("importance_pct")
    )
    return ex.impact_feed(shares, 4)


_SCALED = ["price_per_guest", "cat_cleanliness", "cat_communication", "is_super_host"]


def _scaled_sql() -> str:
    values = {
        "price_per_guest": "price * to_usd / guests", "cat_cleanliness": "cat_cleanliness",
        "cat_communication": "cat_communication", "is_super_host": "is_super_host",
    }
    filled = ", ".join(f"coalesce({e}, (SELECT quantile_disc({e}, 0.5) FROM train)) AS {n}" for n, e in values.items())
    buckets = ["strict", "moderate", "flexible", "unknown"]
    flags = ", ".join(f"CAST(cancellation_bucket = '{b}' AS DOUBLE) AS b_{b}" for b in buckets)
    names = [*values, *[f"b_{b}" for b in buckets]]
    scaled = " UNION ALL ".join(
        "SELECT property_id, '{f}' AS feature, round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0.0), 6) AS value FROM filled".format(
            f=f"cancellation_bucket__ohe_{n[2:].replace('unknown', '__unknown')}" if n.startswith("b_") else f"{n}__imp", c=n
        )
        for n in names
    )
    return f"""train AS (SELECT * FROM feature_listings WHERE ratings IS NOT NULL),
       filled AS (SELECT property_id, {filled}, {flags} FROM train)
       SELECT property_id, feature, value FROM ({scaled})"""


@query(with_sql(_scaled_sql(), d.FEATURE_LISTINGS_SQL))
def scaled_features(spark, sf_dir):
    """M2 M3 M4 M8: imputed, encoded and standardised features by name, on the training rows."""
    from pyspark.ml import Pipeline

    train = ex.training_rows(_features(spark, sf_dir))
    scored = Pipeline(stages=ex.feature_stages(_SCALED, ["cancellation_bucket"], 1e-6)).fit(train).transform(train)
    return ex.long_vectors(scored).select("property_id", "feature", *_six("value"))


def _regression_sql(cell: str, k: int, without_own: bool = False, sweeps: int = 600) -> str:
    """Common table expressions of one regression per area, or per property without itself.

    Everything is worked out again from the rows of each model; coordinate descent runs a
    fixed number of sweeps. ``insights`` has one row per property and feature.
    """
    always = ", ".join(f"('{a.lower()}')" for a in GLOBAL_AMENITIES)
    numbers = {"price_per_guest": "price * to_usd / guests", **{c: c for c, _ in CATEGORY_RATINGS}, "is_super_host": "is_super_host"}
    own = "a.property_id" if without_own else "CAST(NULL AS VARCHAR)"
    model = "m.left_out = a.property_id" if without_own else "m.cell = a.cell"
    return f"""
areas AS (SELECT *, {cell} AS cell FROM feature_listings),
names AS (
  SELECT cell, name FROM (
    SELECT cell, name, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, name) AS n
    FROM amenity_items i JOIN areas a ON a.property_id = i.property_id GROUP BY cell, name) WHERE n <= {k}
  UNION SELECT cell, name FROM (SELECT DISTINCT cell FROM areas), (VALUES {always}) v(name)),
raws AS (
  SELECT cell, property_id, unnest([{', '.join(f"'{n}__imp'" for n in numbers)}]) AS slot, 'n' AS kind,
         unnest([{', '.join(numbers.values())}]) AS value FROM areas
  UNION ALL SELECT a.cell, a.property_id, 'amen_' || replace(replace(n.name, ' ', '_'), '-', '_') || '__imp', 'f',
         CAST(i.name IS NOT NULL AS DOUBLE)
  FROM areas a JOIN names n ON n.cell = a.cell
  LEFT JOIN (SELECT DISTINCT property_id, name FROM amenity_items) i ON i.property_id = a.property_id AND i.name = n.name
  UNION ALL SELECT a.cell, a.property_id, 'cancellation_bucket__ohe_' || c.bucket, 'c', CAST(a.cancellation_bucket = c.bucket AS DOUBLE)
  FROM areas a JOIN (SELECT DISTINCT cell, cancellation_bucket AS bucket FROM areas WHERE ratings IS NOT NULL) c ON c.cell = a.cell),
models AS (SELECT DISTINCT a.cell, {own} AS left_out FROM areas a),
train AS (
  SELECT m.cell, m.left_out, a.property_id, a.ratings, a.cancellation_bucket FROM models m JOIN areas a ON a.cell = m.cell
  WHERE a.ratings IS NOT NULL AND a.property_id IS DISTINCT FROM m.left_out),
thresholds AS (
  SELECT cell, left_out, count(*) AS n, quantile_disc(ratings, 0.8) AS threshold, avg(ratings) AS mean_y, stddev_pop(ratings) AS sd_y
  FROM train GROUP BY cell, left_out),
rows_in AS (
  SELECT t.cell, t.left_out, t.property_id, (t.ratings - h.mean_y) / nullif(h.sd_y, 0) AS y, t.ratings >= h.threshold AS is_top, r.slot, r.kind, r.value
  FROM train t JOIN thresholds h ON h.cell = t.cell AND h.left_out IS NOT DISTINCT FROM t.left_out
  JOIN raws r ON r.property_id = t.property_id),
gaps AS (
  SELECT cell, left_out, slot, kind, CASE WHEN kind = 'n' THEN quantile_disc(value, 0.5) END AS median, sum(value) AS present,
         count(value) AS known, avg(value) FILTER (is_top) AS top_value
  FROM rows_in GROUP BY cell, left_out, slot, kind),
filled AS (
  SELECT r.* EXCLUDE (value), coalesce(r.value, g.median) AS value FROM rows_in r
  JOIN gaps g ON g.cell = r.cell AND g.left_out IS NOT DISTINCT FROM r.left_out AND g.slot = r.slot),
spreads AS (
  SELECT cell, left_out, slot, avg(value) AS mean,
         CASE WHEN min(value) < max(value) THEN stddev_pop(value) ELSE 0 END AS sd, CASE WHEN min(value) < max(value) THEN stddev_samp(value) ELSE 0 END AS sd_sample
  FROM filled GROUP BY cell, left_out, slot),
standard AS (
  SELECT f.cell, f.left_out, f.property_id, f.y, f.slot, (f.value - s.mean) / s.sd AS z
  FROM filled f JOIN spreads s ON s.cell = f.cell AND s.left_out IS NOT DISTINCT FROM f.left_out AND s.slot = f.slot WHERE s.sd > 0),
half AS (
  SELECT a.cell, a.left_out, a.slot AS j, b.slot AS k, avg(a.z * b.z) AS v
  FROM standard a JOIN standard b ON b.cell = a.cell AND b.left_out IS NOT DISTINCT FROM a.left_out AND b.property_id = a.property_id AND a.slot <= b.slot
  GROUP BY a.cell, a.left_out, a.slot, b.slot),
lines AS (
  SELECT cell, left_out, j, list(v ORDER BY k) AS line
  FROM (SELECT * FROM half UNION ALL SELECT cell, left_out, k, j, v FROM half WHERE j < k) GROUP BY cell, left_out, j),
targets AS (SELECT cell, left_out, slot AS j, coalesce(avg(z * y), 0) AS r FROM standard GROUP BY cell, left_out, slot),
systems AS (
  SELECT l.cell, l.left_out, list(l.j ORDER BY l.j) AS slots, list(l.line ORDER BY l.j) AS g, list(t.r ORDER BY l.j) AS r
  FROM lines l JOIN targets t ON t.cell = l.cell AND t.left_out IS NOT DISTINCT FROM l.left_out AND t.j = l.j GROUP BY l.cell, l.left_out),
started AS (
  SELECT s.*, coalesce(0.05 / nullif(h.sd_y, 0), 0) AS w FROM systems s
  JOIN thresholds h ON h.cell = s.cell AND h.left_out IS NOT DISTINCT FROM s.left_out),
solved AS (
  SELECT cell, left_out, slots, list_reduce(
    list_concat([list_transform(r, lambda x: CAST(0 AS DOUBLE))],
      flatten(list_transform(range({sweeps}), lambda s: list_transform(range(1, len(r) + 1), lambda k: [CAST(k AS DOUBLE)])))),
    lambda b, e: list_concat(list_concat(b[1 : CAST(e[1] AS INT) - 1],
      list_transform([r[CAST(e[1] AS INT)] - list_dot_product(g[CAST(e[1] AS INT)], b) + b[CAST(e[1] AS INT)]],
        lambda x: sign(x) * greatest(abs(x) - w, 0) / (1 + w))), b[CAST(e[1] AS INT) + 1 :])) AS beta
  FROM started),
betas AS (SELECT cell, left_out, unnest(slots) AS slot, unnest(beta) AS beta FROM solved),
modes AS (
  SELECT cell, left_out, 'cancellation_bucket__ohe_' || cancellation_bucket AS slot FROM (
    SELECT t.cell, t.left_out, cancellation_bucket, row_number() OVER (PARTITION BY t.cell, t.left_out ORDER BY count(*) DESC, cancellation_bucket) AS n
    FROM train t JOIN thresholds h ON h.cell = t.cell AND h.left_out IS NOT DISTINCT FROM t.left_out WHERE t.ratings >= h.threshold
    GROUP BY t.cell, t.left_out, cancellation_bucket) WHERE n = 1),
fitted AS (
  SELECT g.cell, g.left_out, g.slot, g.kind, g.median, s.mean, s.sd_sample, h.n,
    coalesce(b.beta * h.sd_y * s.sd_sample / nullif(s.sd, 0), 0) + 0.0 AS coef,
    CASE WHEN g.kind <> 'c' THEN g.top_value END AS top_value,
    CASE WHEN s.sd_sample > 0 THEN (CASE WHEN g.kind = 'c' THEN CAST(o.slot IS NOT NULL AS DOUBLE) ELSE coalesce(g.top_value, g.median) END - s.mean) / s.sd_sample ELSE 0 END AS top_scaled
  FROM gaps g JOIN spreads s ON s.cell = g.cell AND s.left_out IS NOT DISTINCT FROM g.left_out AND s.slot = g.slot
  JOIN thresholds h ON h.cell = g.cell AND h.left_out IS NOT DISTINCT FROM g.left_out
  LEFT JOIN betas b ON b.cell = g.cell AND b.left_out IS NOT DISTINCT FROM g.left_out AND b.slot = g.slot
  LEFT JOIN modes o ON o.cell = g.cell AND o.left_out IS NOT DISTINCT FROM g.left_out AND o.slot = g.slot
  WHERE CASE g.kind WHEN 'n' THEN g.known > 0 WHEN 'c' THEN g.present > 0 ELSE true END
  UNION ALL SELECT cell, left_out, 'cancellation_bucket__ohe___unknown', 'c', NULL, 0, 0, n, 0.0, NULL, 0 FROM thresholds),
impacts AS (
  SELECT a.property_id, m.cell, m.slot AS name, m.coef, CASE WHEN m.kind <> 'c' THEN r.value END AS my_value, m.top_value AS market_avg,
    m.coef * CASE WHEN m.sd_sample > 0 THEN (coalesce(r.value, m.median) - m.mean) / m.sd_sample ELSE 0 END AS current_impact,
    m.coef * (m.top_scaled - CASE WHEN m.sd_sample > 0 THEN (coalesce(r.value, m.median) - m.mean) / m.sd_sample ELSE 0 END) AS opportunity
  FROM areas a JOIN fitted m ON {model} LEFT JOIN raws r ON r.property_id = a.property_id AND r.slot = m.slot),
insights AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY property_id ORDER BY round(abs(current_impact), 9) DESC, name) AS INTEGER) AS position,
    abs(current_impact) / coalesce(nullif(sum(abs(current_impact)) OVER (PARTITION BY property_id), 0), 1) * 100 AS importance_pct,
    CASE WHEN coef > 0 THEN 'Positive (Good to have)' WHEN coef < 0 THEN 'Negative (Avoid)' ELSE 'Neutral' END AS market_trend
  FROM impacts)
"""


_AREA = "'r-' || country"
_INSIGHTS = """SELECT property_id, position, name, market_trend, round(my_value, 6) AS my_value, round(market_avg, 6) AS market_avg,
       round(current_impact, 6) + 0.0 AS current_impact, round(opportunity, 6) + 0.0 AS opportunity, round(importance_pct, 6) + 0.0 AS importance_pct
       FROM insights"""


def _shown(insights):
    plus = [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in ("current_impact", "opportunity", "importance_pct")]
    return insights.select("property_id", "position", "name", "market_trend", *_six("my_value", "market_avg"), *plus)


def _insight_listings(spark, sf_dir):
    return d.stored(d.feature_listings(spark, sf_dir), "listings")


@query(with_sql(
    "SELECT CAST(4 AS INTEGER) AS res, cell, n, slot AS feature, round(coef, 6) + 0.0 AS coef FROM fitted",
    d.FEATURE_LISTINGS_SQL, _regression_sql(_AREA, 20)))
def cell_coefficients(spark, sf_dir):
    """M5 M8 M9: the coefficients of every area's model, all areas in one job."""
    models = ri.fit_cells(_insight_listings(spark, sf_dir), ft.fx_rates(spark))
    return cm.coefficients(models).withColumn("coef", F.round("coef", 6) + F.lit(0.0))


@query(with_sql(_INSIGHTS, d.FEATURE_LISTINGS_SQL, _regression_sql("'all'", 10)))
def rating_regression_insights(spark, sf_dir):
    """One model over all listings, its insights for every listing."""
    models = ri.fit_everywhere(_insight_listings(spark, sf_dir), ft.fx_rates(spark), 10)
    return _shown(cm.explain_members(models))


@query(with_sql(_INSIGHTS, d.FEATURE_LISTINGS_SQL, _regression_sql(_AREA, 20, without_own=True)))
def property_insights(spark, sf_dir):
    """Every listing explained by the model of its area, fitted without that listing."""
    return _shown(ri.explain_properties(_insight_listings(spark, sf_dir), ft.fx_rates(spark)))


@query(with_sql(
    """top AS (SELECT *, CAST(row_number() OVER (PARTITION BY property_id ORDER BY importance_pct DESC, name) AS INTEGER) AS rank
         FROM (SELECT * REPLACE (round(importance_pct, 9) AS importance_pct) FROM insights WHERE importance_pct > 0)),
       labelled AS (SELECT *, replace(replace(replace(name, '__imp', ''), 'amen_', ''), '_', ' ') AS plain FROM top WHERE rank <= 5)
       SELECT property_id, rank AS position, rank || '. ' || array_to_string(list_transform(string_split(plain, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
         || ' (' || printf('%.0f', round(importance_pct, 0)) || '%) - You: ' || coalesce(CAST(round(my_value, 9) AS VARCHAR), 'N/A') || ', Avg: '
         || coalesce(printf('%.2f', round(market_avg, 2)), 'N/A') || ', Impact: ' || printf('%+.2f', round(current_impact, 2))
         || CASE WHEN opportunity > 0.05 THEN ' | Opp: +' || printf('%.2f', round(opportunity, 2)) ELSE '' END AS line
       FROM labelled""", d.FEATURE_LISTINGS_SQL, _regression_sql(_AREA, 20)))
def cell_insights(spark, sf_dir):
    """Readable lines of the strongest insights, one model per region, all in one job."""
    insights = ri.explain_cells(_insight_listings(spark, sf_dir), ft.fx_rates(spark))
    lines = insights.withColumn("importance_pct", F.round("importance_pct", 9)).withColumn("my_value", F.round("my_value", 9))
    return ex.insight_lines(lines, 5)


@query()
def combined_report(spark, sf_dir):
    """Topic report and insights joined per hotel, other sources refused."""
    listings = d.stored(d.feature_listings(spark, sf_dir), "listings")
    df, numerics, categoricals = ri.feature_frame(listings, ft.fx_rates(spark), 5)
    insights = ri.explain_all(df, ri.fit_ratings(df, numerics, categoricals), 10)
    reports = listings.select("property_id", F.to_json(F.struct("name", "location")).alias("payload_json"))
    hotels = listings.select(
        F.when(F.col("currency") == "GBP", ids.prefixed("BKG", F.col("property_id"))).otherwise(
            ids.prefixed("ABB", F.col("property_id"))
        ).alias("hotel_id")
    )
    return ri.combined_report(reports, insights, hotels)
