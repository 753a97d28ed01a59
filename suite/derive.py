"""Hospitality-shaped frames derived from the test tables, and the same frames in SQL.

Every frame covers its whole base table. For each function ``x`` the constant ``X_SQL``
holds the common table expressions that give the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.sources.shared import shared_folder
from innsight.sources.tables import spread


ROW_KEYS = {
    "documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"],
    "events": ["event_id"], "orders": ["o_orderkey"], "part": ["p_partkey"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def costly(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table whose rows take much work, spread over the cores."""
    return spread(table(spark, sf_dir, name), *ROW_KEYS[name])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table of its own, as listings are in practice: derived once, read often."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_sql(select: str, *ctes: str) -> str:
    """The common table expressions, then the select, which may start with more of them."""
    parts = list(dict.fromkeys(c.strip().rstrip(",") for c in ctes))
    if not select.lstrip().upper().startswith("SELECT"):
        return "WITH " + ",\n".join([*parts, select])
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- documents as listings: the paragraphs of a text are its reviews --------------------

def review_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = costly(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("property_id"), F.to_json(F.split("text", "\n")).alias("reviews")
    )


REVIEW_ROWS_SQL = r"""
review_rows AS (
  SELECT CAST(doc_id AS VARCHAR) AS property_id,
         regexp_replace(lower(unnest(parts)), '[ \t\n\x0B\f\r]+', ' ', 'g') AS review_text,
         CAST(unnest(range(len(parts))) AS INTEGER) AS review_idx
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
"""

SENTENCE_ROWS_SQL = r"""
sentence_parts AS (
  SELECT property_id, review_idx,
         string_split(regexp_replace(review_text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM review_rows),
sentence_rows AS (
  SELECT property_id, review_idx, sent_idx, sentence_text,
         sha256(property_id || '||' || review_idx || '||' || sent_idx || '||' || sentence_text) AS sentence_id
  FROM (SELECT property_id, review_idx, unnest(parts) AS sentence_text,
               CAST(unnest(range(len(parts))) AS INTEGER) AS sent_idx FROM sentence_parts)
  WHERE length(sentence_text) > 0)
"""


# --- documents as reviews of the property ``source`` -------------------------------------

TOPIC_WORDS = {
    "determiners": ["the", "this", "that"],
    "prepositions": ["of ", " with", "from"],
    "verb forms": ["was", "are", " be "],
    "endings": ["tion", "ing", "ment"],
    "german words": ["und", "der", "nicht"],
    "french words": ["les", "que", "pour"],
    "spanish words": ["los", "para", "do "],
    "rare sounds": ["thth", "eauou", "ung"],
}


def source_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents with the property ``source``; labels give the sentiment."""
    from innsight.operators.sentences import split_sentences

    docs, labels = costly(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sentiment = (
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "negative")
        .when(F.col("quality").isNotNull(), "positive")
        .otherwise("na")
    )
    from innsight.functions.text import normalise_review

    reviews = docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("property_id"), F.col("doc_id").cast("int").alias("review_idx"),
        normalise_review(F.col("text")).alias("review_text"), sentiment.alias("sentiment_label"),
    )
    return split_sentences(reviews, keep=("sentiment_label",))


SOURCE_SENTENCES_SQL = r"""
source_reviews AS (
  SELECT source AS property_id, CAST(d.doc_id AS INTEGER) AS review_idx,
         regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g') AS review_text,
         CASE WHEN toxic = 1 OR quality = 0 THEN 'negative' WHEN quality IS NOT NULL THEN 'positive'
              ELSE 'na' END AS sentiment_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
source_parts AS (
  SELECT property_id, review_idx, sentiment_label,
         string_split(regexp_replace(review_text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM source_reviews),
source_sentences AS (
  SELECT property_id, review_idx, sent_idx, sentiment_label, sentence_text,
         sha256(property_id || '||' || review_idx || '||' || sent_idx || '||' || sentence_text) AS sentence_id
  FROM (SELECT property_id, review_idx, sentiment_label, unnest(parts) AS sentence_text,
               CAST(unnest(range(len(parts))) AS INTEGER) AS sent_idx FROM source_parts)
  WHERE length(sentence_text) > 0),
english_sentences AS (
  SELECT * FROM source_sentences
  WHERE regexp_matches(sentence_text, '[A-Za-z]')
    AND length(regexp_replace(sentence_text, '[\x00-\x7F]', '', 'g'))
        / CAST(greatest(length(sentence_text), 1) AS DOUBLE) <= 0.20)
"""


def _assignments_sql() -> str:
    scores = " UNION ALL ".join(
        "SELECT property_id, sentence_id, '{t}' AS topic, ({s}) / 3.0::DOUBLE AS topic_similarity "
        "FROM english_sentences".format(
            t=topic, s=" + ".join(f"CAST(contains(sentence_text, '{w}') AS INTEGER)" for w in words)
        )
        for topic, words in TOPIC_WORDS.items()
    )
    return f"""
topic_scores AS ({scores}),
assignments AS (
  SELECT property_id, sentence_id, topic, topic_similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY property_id, sentence_id ORDER BY topic_similarity DESC, topic) AS rn
    FROM topic_scores WHERE topic_similarity > 0) WHERE rn <= 2),
enriched AS (
  SELECT s.property_id, review_idx, sent_idx, s.sentence_id, topic, topic_similarity, sentiment_label, sentence_text
  FROM source_sentences s JOIN assignments a ON s.property_id = a.property_id AND s.sentence_id = a.sentence_id)
"""


ASSIGNMENTS_SQL = _assignments_sql()


def source_assignments(sentences: DataFrame) -> DataFrame:
    from innsight.operators.topics import topics_by_keyword

    return topics_by_keyword(sentences, TOPIC_WORDS)


def source_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per source, its vector being the number of documents per language."""
    docs = table(spark, sf_dir, "documents")
    counts = [F.count_if(F.col("lang") == lang).cast("double") for lang in ("de", "en", "es", "fr")]
    return docs.groupBy(F.col("source").alias("property_id")).agg(F.array(*counts).alias("similarity_vec")).select(
        "property_id", F.lit("all").alias("geo_bucket"), F.lit(7).alias("geo_bucket_res"),
        F.lit("all").alias("h3_7"), "similarity_vec",
    )


SOURCE_NEIGHBOURS_SQL = r"""
source_vectors AS (
  SELECT source AS property_id,
         [count(*) FILTER (lang = 'de'), count(*) FILTER (lang = 'en'),
          count(*) FILTER (lang = 'es'), count(*) FILTER (lang = 'fr')]::DOUBLE[] AS vec
  FROM documents GROUP BY source),
source_neighbours AS (
  SELECT * FROM (
    SELECT a.property_id, b.property_id AS neighbor_property_id,
           round(list_cosine_similarity(a.vec, b.vec), 9) AS similarity,
           CAST(row_number() OVER (PARTITION BY a.property_id
                ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.property_id) AS INTEGER) AS rank
    FROM source_vectors a JOIN source_vectors b ON a.property_id <> b.property_id) WHERE rank <= 5)
"""


def source_comparison(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Enriched sentences of all sources, and the five nearest sources of each."""
    from innsight.operators.neighbours import top_neighbours
    from innsight.plans.property_comparison import keyword_tagger

    enriched = keyword_tagger(TOPIC_WORDS)(source_sentences(spark, sf_dir))
    return enriched, top_neighbours(source_listings(spark, sf_dir), k=5)


# --- embeddings as listings with cells of three resolutions -------------------------------

def vector_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    cells = e.select(
        F.col("vec_id").cast("string").alias("property_id"),
        F.col("embedding").alias("similarity_vec"),
        (F.lit(5) + F.pmod("vec_id", F.lit(3))).cast("int").alias("geo_bucket_res"),
        F.concat(F.lit("c5-"), F.floor(F.col("label") / 5).cast("string")).alias("h3_5"),
        F.concat(F.lit("c6-"), F.floor(F.col("label") / 2).cast("string")).alias("h3_6"),
        F.concat(F.lit("c7-"), F.col("label").cast("string")).alias("h3_7"),
    )
    bucket = F.when(F.col("geo_bucket_res") == 5, F.col("h3_5")).when(
        F.col("geo_bucket_res") == 6, F.col("h3_6")
    ).otherwise(F.col("h3_7"))
    return cells.withColumn("geo_bucket", bucket)


VECTOR_LISTINGS_SQL = r"""
vector_cells AS (
  SELECT CAST(vec_id AS VARCHAR) AS property_id, CAST(embedding AS DOUBLE[]) AS vec,
         CAST(5 + vec_id % 3 AS INTEGER) AS geo_bucket_res,
         'c5-' || CAST(label // 5 AS VARCHAR) AS h3_5, 'c6-' || CAST(label // 2 AS VARCHAR) AS h3_6,
         'c7-' || CAST(label AS VARCHAR) AS h3_7
  FROM embeddings),
vector_listings AS (
  SELECT *, CASE geo_bucket_res WHEN 5 THEN h3_5 WHEN 6 THEN h3_6 ELSE h3_7 END AS geo_bucket FROM vector_cells),
vector_members AS (
  SELECT property_id, vec, 5 AS res, h3_5 AS cell FROM vector_listings UNION ALL
  SELECT property_id, vec, 6, h3_6 FROM vector_listings UNION ALL
  SELECT property_id, vec, 7, h3_7 FROM vector_listings),
vector_pairs AS (
  SELECT t.property_id, m.property_id AS neighbor_property_id,
         round(list_cosine_similarity(t.vec, m.vec), 9) AS similarity
  FROM vector_listings t JOIN vector_members m ON t.geo_bucket_res = m.res AND t.geo_bucket = m.cell
  WHERE t.property_id <> m.property_id),
vector_neighbours AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY property_id
         ORDER BY similarity DESC, neighbor_property_id) AS INTEGER) AS rank FROM vector_pairs) WHERE rank <= 20)
"""


# --- documents as booking hotels, and as airbnb listings with free-form reviews -----------

def booking_hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = costly(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    parts = F.split("text", "\n")
    reviews = F.transform(
        parts, lambda p: F.struct(F.nullif(p, F.lit("")).alias("review"), F.col("lang").alias("reviewer_name"))
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("hotel_id"),
        F.when(F.col("lang") != "es", F.concat(F.lit("Hotel "), "source", F.lit(" "), F.col("n_chars").cast("string"))).alias("title"),
        F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).alias("description"),
        F.col("source").alias("city"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("country"),
        (F.col("quality") * 4 + F.col("toxic")).cast("double").alias("review_score"),
        F.array("lang", "source").alias("most_popular_facilities"),
        F.when(F.size(parts) > 2, reviews).alias("top_reviews"),
    )


BOOKING_HOTELS_SQL = r"""
booking_hotels AS (
  SELECT d.doc_id AS hotel_id, CASE WHEN lang <> 'es' THEN 'Hotel ' || source || ' ' || n_chars END AS title,
         CASE WHEN len(string_split(text, chr(10))) > 1 THEN string_split(text, chr(10))[1] END AS description,
         source AS city, CASE WHEN lang <> 'fr' THEN lang END AS country,
         CAST(quality * 4 + toxic AS DOUBLE) AS review_score, lang || ', ' || source AS facilities,
         CASE WHEN len(string_split(text, chr(10))) > 2 THEN string_split(text, chr(10)) END AS parts
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
booking_hotel_documents AS (
  SELECT 'booking_hotels' AS namespace, 'BKG_' || hotel_id AS doc_id, 'booking' AS source,
         'BKG_' || hotel_id AS hotel_id, CAST(hotel_id AS VARCHAR) AS original_id,
         coalesce(title, 'Unknown Hotel') AS title, city, coalesce(country, 'Unknown') AS country,
         coalesce(review_score, 0.0) AS rating,
         'Hotel: ' || coalesce(title, 'Unknown Hotel') || '. Location: ' || city || ', '
         || coalesce(country, 'Unknown') || '. Rating: ' || coalesce(CAST(review_score AS VARCHAR), 'None')
         || '. Facilities: ' || facilities || '. Description: ' || coalesce(description, '') AS text
  FROM booking_hotels),
booking_review_documents AS (
  SELECT 'booking_reviews' AS namespace, 'BKG_' || hotel_id || '_R' || pos AS doc_id, 'booking' AS source,
         'BKG_' || hotel_id AS hotel_id, CAST(hotel_id AS VARCHAR) AS original_id, title, city, country,
         CAST(NULL AS DOUBLE) AS rating,
         'Review for ' || coalesce(title, 'None') || ' in ' || city || ': ' || review AS text
  FROM (SELECT hotel_id, title, city, country, unnest(parts) AS review, unnest(range(len(parts))) AS pos
        FROM booking_hotels WHERE parts IS NOT NULL) WHERE review <> '')
"""


def airbnb_listings(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Listings whose review strings take eight forms, chosen by the length of the text."""
    docs = costly(spark, sf_dir, "documents")
    parts = F.split("text", "\n")
    form = F.pmod("n_chars", F.lit(8))
    as_json = F.to_json(F.array("text"))
    numbered = F.transform(parts, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p))
    reviews = (
        F.when(form == 0, F.to_json(parts))
        .when(form == 1, F.to_json(F.transform(parts, lambda p: F.struct(p.alias("text")))))
        .when(form == 2, F.substr(as_json, F.lit(2), F.length(as_json) - 2))
        .when(form == 3, F.array_join(numbered, " "))
        .when(form == 4, F.array_join(parts, "\n\n"))
        .when(form == 5, F.array_join(parts, "|"))
        .when(form == 6, F.array_join(parts, "---"))
        .otherwise(F.col("text"))
    )
    comma = F.concat(F.floor(F.col("n_chars") / 100 % 5).cast("string"), F.lit(","), F.pmod("n_chars", F.lit(100)).cast("string"))
    return docs.withColumn("form", form).select(
        *keep,
        F.when(F.col("lang") != "es", F.col("doc_id").cast("string")).alias("property_id"),
        F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.concat(F.lit("Flat "), F.col("doc_id").cast("string"))).alias("name"),
        F.when(F.col("lang") == "fr", "").when(F.col("lang") == "en", F.concat(F.lit("Home "), "source")).alias("listing_name"),
        F.get(parts, F.lit(0)).alias("description"),
        F.concat("source", F.lit(" centre")).alias("location"),
        F.col("lang").alias("country"),
        F.when(F.col("lang") == "fr", "n/a").when(F.col("lang") == "de", comma).when(
            F.col("lang") == "en", F.replace(comma, F.lit(","), F.lit("."))
        ).alias("ratings"),
        F.lit("[]").alias("amenities"),
        F.pmod("doc_id", F.lit(5)).cast("double").alias("guests"),
        F.when(F.col("n_chars") > 100, F.col("n_chars").cast("double")).alias("price"),
        F.lit("Entire home").alias("category"),
        reviews.alias("reviews"),
    )


AIRBNB_LISTINGS_SQL = r"""
airbnb_parts AS (
  SELECT *, string_split(text, chr(10)) AS parts, n_chars % 8 AS form,
         CAST(CAST(floor(n_chars / 100 % 5) AS BIGINT) AS VARCHAR) || ',' || CAST(n_chars % 100 AS VARCHAR) AS comma
  FROM documents),
airbnb_listings AS (
  SELECT CASE WHEN lang <> 'es' THEN CAST(doc_id AS VARCHAR) END AS property_id,
         CASE WHEN lang = 'de' THEN NULL ELSE 'Flat ' || doc_id END AS name,
         CASE WHEN lang = 'fr' THEN '' WHEN lang = 'en' THEN 'Home ' || source END AS listing_name,
         parts[1] AS description, source || ' centre' AS location, lang AS country,
         CASE lang WHEN 'fr' THEN 'n/a' WHEN 'de' THEN comma WHEN 'en' THEN replace(comma, ',', '.') END AS ratings,
         '[]' AS amenities, CAST(doc_id % 5 AS DOUBLE) AS guests,
         CASE WHEN n_chars > 100 THEN CAST(n_chars AS DOUBLE) END AS price, 'Entire home' AS category,
         form, parts, text,
         CASE form WHEN 3 THEN array_to_string(list_transform(parts, lambda p, i: i || '. ' || p), ' ')
                   WHEN 4 THEN array_to_string(parts, chr(10) || chr(10)) WHEN 5 THEN array_to_string(parts, '|')
                   WHEN 6 THEN array_to_string(parts, '---') ELSE text END AS raw
  FROM airbnb_parts),
airbnb_reviews AS (
  SELECT *, CASE
      WHEN form <> 0 AND form <> 1 AND trim(raw, e' \t\n\r\f' || chr(11)) = '' THEN []
      WHEN form = 0 THEN parts
      WHEN form = 1 THEN list_transform(parts, lambda p: CASE WHEN p = '' THEN '{"text":""}' ELSE p END)
      WHEN form = 2 THEN [text]
      WHEN contains(raw, '1.') OR contains(raw, '2.') OR contains(raw, '3.') OR contains(raw, '4.') THEN
        list_filter(list_transform(regexp_split_to_array(raw, '\d+\.[ \t\n\x0B\f\r]*'),
                    lambda p: trim(p, e' \t\n\r\f' || chr(11))), lambda p: p <> '')
      WHEN contains(raw, chr(10) || chr(10)) THEN
        list_filter(list_transform(string_split(raw, chr(10) || chr(10)), lambda p: trim(p, e' \t\n\r\f' || chr(11))), lambda p: p <> '')
      WHEN contains(raw, '|') THEN
        list_filter(list_transform(string_split(raw, '|'), lambda p: trim(p, e' \t\n\r\f' || chr(11))), lambda p: p <> '')
      WHEN contains(raw, '---') THEN
        list_filter(list_transform(string_split(raw, '---'), lambda p: trim(p, e' \t\n\r\f' || chr(11))), lambda p: p <> '')
      WHEN length(raw) > 20 THEN [raw] ELSE [] END AS reviews
  FROM airbnb_listings),
airbnb_identified AS (
  SELECT *, coalesce(nullif(property_id, ''), substr(sha256(concat_ws(chr(1), coalesce(name, ''),
           coalesce(listing_name, ''), coalesce(location, ''), coalesce(country, ''), coalesce(description, ''))), 1, 16)) AS original_id,
         coalesce(nullif(listing_name, ''), nullif(name, ''), 'Unknown Property') AS hotel_title,
         coalesce(nullif(listing_name, ''), nullif(name, ''), 'Airbnb Property') AS review_title,
         coalesce(try_cast(replace(ratings, ',', '.') AS DOUBLE), 0.0) AS rating
  FROM airbnb_reviews),
airbnb_hotel_documents AS (
  SELECT 'airbnb_hotels' AS namespace, 'ABB_' || original_id AS doc_id, 'airbnb' AS source,
         'ABB_' || original_id AS hotel_id, original_id, hotel_title AS title, location AS city, country, rating,
         'Property: ' || hotel_title || '. Location: ' || location || ', ' || country || '. Rating: '
         || CAST(rating AS VARCHAR) || '. Guests: ' || CAST(guests AS VARCHAR) || '. Category: ' || category
         || '. Price: ' || coalesce(CAST(price AS VARCHAR), 'None') || '. Amenities: ' || amenities
         || '. Description: ' || description AS text
  FROM airbnb_identified),
airbnb_review_documents AS (
  SELECT 'airbnb_reviews' AS namespace, 'ABB_' || original_id || '_R' || pos AS doc_id, 'airbnb' AS source,
         'ABB_' || original_id AS hotel_id, original_id, review_title AS title, location AS city, country,
         CAST(NULL AS DOUBLE) AS rating, 'Review for ' || review_title || ' in ' || location || ': ' || review AS text
  FROM (SELECT original_id, review_title, location, country, unnest(reviews) AS review,
               unnest(range(len(reviews))) AS pos FROM airbnb_identified)
  WHERE length(review) >= 10)
"""

CORPUS_SQL = BOOKING_HOTELS_SQL.rstrip() + "," + AIRBNB_LISTINGS_SQL.rstrip() + r""",
corpus AS (
  SELECT * FROM booking_hotel_documents UNION ALL SELECT * FROM booking_review_documents UNION ALL
  SELECT * FROM airbnb_hotel_documents UNION ALL SELECT * FROM airbnb_review_documents)
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innsight.plans.ingestion import build_corpus

    return build_corpus(booking_hotels(spark, sf_dir), airbnb_listings(spark, sf_dir))


# --- customers as listings with features; the parts they bought are the amenities ---------

def feature_listings(spark: SparkSession, sf_dir: str, amenities: bool = True) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    segment = F.col("c_mktsegment")
    cents = F.floor(F.abs("c_acctbal")).cast("bigint")
    rating = (F.pmod(cents, F.lit(500)) / F.lit(100.0)).cast("string")

    def score(shift: int):
        return (F.pmod(cents + shift, F.lit(50)) / F.lit(10.0)).cast("string")

    ratings_json = F.concat(
        F.lit('[{"name":"Cleanliness","value":"'), score(0), F.lit('"},{"name":"Check-in","value":"'), score(7),
        F.when(segment != "BUILDING", F.concat(F.lit('"},{"name":"Communication","value":"'), score(13))).otherwise(""),
        F.lit('"}]'),
    )
    listings = (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").cast("string").alias("property_id"), F.col("c_name").alias("name"),
            F.col("n_name").alias("location"), F.col("r_name").alias("country"),
            F.when(segment == "MACHINERY", F.lit(None)).otherwise(rating).alias("ratings"),
            F.col("c_acctbal").alias("price"),
            F.when(segment == "HOUSEHOLD", F.lit(None)).when(segment == "BUILDING", "EUR")
            .when(segment == "FURNITURE", "GBP").otherwise("USD").alias("currency"),
            F.when(segment == "AUTOMOBILE", F.lit(None)).otherwise(F.pmod("c_custkey", F.lit(5)).cast("double")).alias("guests"),
            F.when(segment == "AUTOMOBILE", "No refund after booking")
            .when(segment == "BUILDING", "Partial refund, then no refund")
            .when(segment == "FURNITURE", "A Partial Refund is possible")
            .when(segment == "HOUSEHOLD", "Full refund 24h before arrival").alias("cancellation_policy"),
            ratings_json.alias("category_rating"), (F.col("c_acctbal") > 5000).alias("is_super_host"),
            F.concat(F.lit("n-"), F.col("n_name")).alias("h3_5"), F.concat(F.lit("r-"), F.col("r_name")).alias("h3_4"),
            F.lit(4).alias("geo_bucket_res"), F.concat(F.lit("r-"), F.col("r_name")).alias("geo_bucket"),
        )
    )
    if not amenities:
        return listings
    lines, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    amenity = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("Wide TV "), "p_name"))
        .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Hair dryer, "), "p_name"))
        .otherwise(F.initcap("p_name"))
    )
    # names are worked out per part; lines reach their customer once, and are told apart and listed there
    parts = part.select("p_partkey", amenity.alias("name"))
    owners = orders.select("o_orderkey", F.col("o_custkey").cast("bigint").alias("_owner"))
    bought = (
        lines.select("l_orderkey", "l_partkey").join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("_owner", "name").repartition("_owner").distinct()
    )
    # bounded: names come from the part vocabulary
    items = bought.groupBy("_owner").agg(
        F.sort_array(F.collect_list(F.struct("name", F.lit("x").alias("value")))).alias("items")
    )
    groups = F.array(
        F.struct(F.lit("Things").alias("group_name"), F.col("items")),
        F.struct(F.lit("Nothing").alias("group_name"), F.slice("items", 1, 0).alias("items")),
    )
    return listings.join(items, F.col("property_id").cast("bigint") == F.col("_owner"), "left").withColumn(
        "amenities", F.when(F.col("items").isNotNull(), F.to_json(groups))
    ).drop("items", "_owner")


FEATURE_LISTINGS_SQL = r"""
listing_base AS (
  SELECT c.*, n_name, r_name, CAST(floor(abs(c_acctbal)) AS BIGINT) AS cents
  FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
feature_listings AS (
  SELECT CAST(c_custkey AS VARCHAR) AS property_id, n_name AS location, r_name AS country, c_mktsegment,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN (cents % 500) / 100.0::DOUBLE END AS ratings,
         c_acctbal AS price,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'EUR' WHEN 'FURNITURE' THEN 'GBP' ELSE 'USD' END AS currency,
         CASE c_mktsegment WHEN 'BUILDING' THEN 1.05::DOUBLE WHEN 'FURNITURE' THEN NULL ELSE 1.0::DOUBLE END AS to_usd,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' OR c_custkey % 5 = 0 THEN 1.0::DOUBLE ELSE CAST(c_custkey % 5 AS DOUBLE) END AS guests,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'strict' WHEN 'BUILDING' THEN 'strict' WHEN 'FURNITURE' THEN 'moderate'
              WHEN 'HOUSEHOLD' THEN 'flexible' ELSE 'unknown' END AS cancellation_bucket,
         (cents % 50) / 10.0::DOUBLE AS cat_cleanliness, ((cents + 7) % 50) / 10.0::DOUBLE AS cat_checkin,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN ((cents + 13) % 50) / 10.0::DOUBLE END AS cat_communication,
         CAST(c_acctbal > 5000 AS DOUBLE) AS is_super_host
  FROM listing_base),
bought AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS property_id,
         CASE p_type WHEN 'PROMO' THEN 'Wide TV ' || p_name WHEN 'ECONOMY' THEN 'Hair dryer, ' || p_name
              ELSE p_name END AS raw_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE CAST(o_custkey AS VARCHAR) IN (SELECT property_id FROM feature_listings)),
amenity_items AS (
  SELECT property_id, CASE WHEN contains(lower(raw_name), 'tv') THEN 'tv'
         WHEN contains(lower(raw_name), 'hair dryer') THEN 'hair dryer' ELSE lower(raw_name) END AS name FROM bought)
"""


# --- map pages: the paragraphs of a page become review cards -------------------------------

def map_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = costly(spark, sf_dir, "pages")
    paragraphs = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    cards = F.transform(
        paragraphs,
        lambda p, i: F.concat(
            F.lit('<div class="card jftiEf"><div class="d4r55"><div>Reader</div> '), i.cast("string"),
            F.lit('</div><span role="img" aria-label="'), (i % 5 + 1).cast("string"),
            F.lit(' stars"></span><span class="rsqaWe">'), i.cast("string"),
            F.lit(' days ago</span><span class="wiI7pd"><span>'), p,
            F.lit('</span><SPAN/><span class="more"> (<span>more</span>)</span></span><span>Like</span></div>'),
        ),
    )
    html = F.concat(
        F.lit('<div class="fontDisplayLarge">'), F.pmod("page_id", F.lit(5)).cast("string"),
        F.when(F.pmod("page_id", F.lit(2)) == 0, ",").otherwise("."), F.lit("5</div>"),
        F.lit('<button class="x fontBodyMedium">reviews</button><span class="fontBodyMedium"><span>all</span> ('),
        F.format_number(F.length("html"), 0), F.lit(")</span>"), F.array_join(cards, ""),
    )
    url = F.concat(
        "url", F.lit("/@"), F.pmod("page_id", F.lit(90)).cast("string"), F.lit(".5204,-0."),
        F.col("page_id").cast("string"), F.lit(",17z/"),
    )
    return pages.select("page_id", url.alias("url"), html.alias("html"))


# --- search payloads out of pages, in five shapes -------------------------------------------

_LINKS = '<a href="([^"]*)">([^<]*)</a>'


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = costly(spark, sf_dir, "pages")
    links = F.zip_with(
        F.regexp_extract_all("html", F.lit(_LINKS), F.lit(1)), F.regexp_extract_all("html", F.lit(_LINKS), F.lit(2)),
        lambda href, text: F.struct(href.alias("link"), text.alias("title")),
    )
    advert = F.regexp_extract("html", '<div class="ad">([^<]*)</div>', 1)
    organic = F.transform(links, lambda x: F.struct(x["title"].alias("title"), F.concat(x["title"], F.lit(" and "), advert).alias("description"), x["link"].alias("link")))
    results = F.transform(links, lambda x: F.struct(x["title"].alias("title"), advert.alias("snippet"), x["link"].alias("url")))
    organic_json = F.to_json(F.struct(organic.alias("organic")))
    form = F.pmod(F.length("url"), F.lit(5))
    text = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<[^>]*>", " ")
    payload = (
        F.when(form == 0, organic_json)
        .when(form == 1, F.concat(F.lit('{"body":'), organic_json, F.lit("}")))
        .when(form == 2, F.to_json(F.struct(organic_json.alias("body"))))
        .when(form == 3, F.to_json(F.struct(results.alias("results"))))
        .otherwise(F.replace(text, F.lit(" the "), F.lit(" the hotel ")))
    )
    return pages.select(F.col("page_id").alias("request_id"), payload.alias("payload"))


SEARCH_HITS_SQL = r"""
payload_parts AS (
  SELECT page_id AS request_id, length(url) % 5 AS form,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS links,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS titles,
         regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS advert,
         replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'),
                 ' the ', ' the hotel ') AS raw
  FROM pages),
listed_hits AS (
  SELECT request_id, unnest(range(len(titles))) AS pos, unnest(titles) AS title, unnest(links) AS link, form, advert
  FROM payload_parts WHERE form < 4),
raw_snippets AS (
  SELECT request_id, regexp_extract_all(raw,
     '((?i)[A-Z][^.!?]*(?:review|hotel|wifi|guest|stay|room|service|clean)[^.!?]*[.!?])', 1) AS found
  FROM payload_parts WHERE form = 4),
raw_hits AS (
  SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY i) - 1 AS INTEGER) AS pos,
         'Result ' || (i + 1) AS title, substr(s, 1, 300) AS snippet, '' AS link
  FROM (SELECT request_id, unnest(found) AS s, unnest(range(len(found))) AS i FROM raw_snippets)
  WHERE i < 10 AND length(s) > 30),
search_hits AS (
  SELECT request_id, CAST(pos AS INTEGER) AS pos, title,
         substr(CASE WHEN form = 3 THEN advert ELSE title || ' and ' || advert END, 1, 300) AS snippet, link
  FROM listed_hits WHERE pos < 10 UNION ALL SELECT * FROM raw_hits)
"""


# --- event payloads out of orders, weather payloads out of events, map payloads out of parts -

def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = costly(spark, sf_dir, "orders")
    show = F.concat(F.lit("Show "), "o_orderstatus")
    widget = F.array(
        F.struct(show.alias("title"), F.concat(F.lit("Hall "), F.col("o_custkey").cast("string")).alias("venue"),
                 F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MMM d")).alias("date")),
    )
    organic = F.array(
        F.struct(F.concat(F.lit(" Concert "), "o_orderpriority").alias("title"),
                 F.concat(F.lit("Doors open on "), F.date_format("o_orderdate", "EEE, MMM d")).alias("description"),
                 F.lit("http://a").alias("link")),
        F.struct(F.lit("Login to buy").alias("title"), F.lit("now").alias("description"), F.lit("http://b").alias("link")),
        F.struct(F.upper(show).alias("title"), F.lit("again").alias("description"), F.lit("http://c").alias("link")),
        F.struct(F.concat(F.lit("Fair "), F.date_format("o_orderdate", "d/M/yyyy")).alias("title"),
                 F.lit("").alias("description"), F.lit("http://d").alias("link")),
        F.struct(F.lit("Parade in march").alias("title"), F.lit("free").alias("description"), F.lit("http://e").alias("link")),
        F.struct(F.lit("Open house").alias("title"), F.lit("free").alias("description"), F.lit("http://f").alias("link")),
    )
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.to_json(F.struct(widget.alias("events"), organic.alias("organic"))).alias("payload")
    )


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = costly(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    value = F.col("value").cast("string")
    days = F.transform(
        F.sequence(F.lit(1), F.lit(5)),
        lambda i: F.struct(F.concat(F.lit("Day "), i.cast("string")).alias("day"),
                           F.struct(F.concat(k, F.lit("."), i.cast("string")).alias("daytime"),
                                    F.when(i != 2, k).alias("nighttime")).alias("temperature")),
    )
    payload = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(F.struct(
            value.alias("temperature"), F.array(F.lit("now"), F.concat(F.lit("Cloudy "), k)).alias("subtitles"),
            F.array(F.struct(F.lit("Humidity").alias("type"), F.concat(k, F.lit("%")).alias("text")),
                    F.struct(F.lit("Wind").alias("type"), F.lit("").alias("text"))).alias("additional_info"),
            days.alias("daily_forecast")).alias("weather"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(F.struct(
            value.alias("temp"), F.lit("Sunny").alias("description"), k.alias("humidity"), F.lit("5 km/h").alias("wind")).alias("weather"))))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.struct(F.concat(F.lit("It is "), k).alias("snippet")).alias("answer_box"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.struct(F.concat(F.lit("A city with "), k).alias("description")).alias("knowledge_graph"))))
        .otherwise(F.to_json(F.struct(F.array(
            F.struct(F.lit("Weather today").alias("title"), F.concat(F.lit("about "), k).alias("description")),
            F.struct(F.lit("Forecast").alias("title"), F.concat(value, F.lit("°C")).alias("description")),
            F.struct(F.lit("News").alias("title"), F.lit("none").alias("description"))).alias("organic"))))
    )
    return e.select(F.col("event_id").alias("request_id"), payload.alias("payload"))


def map_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = costly(spark, sf_dir, "part")
    items = F.transform(
        F.sequence(F.lit(1), F.pmod("p_size", F.lit(8)) + 1),
        lambda i: F.struct(
            F.concat("p_name", F.lit(" "), i.cast("string")).alias("name"),
            F.concat(i.cast("string"), F.lit(".5")).alias("rating"),
            F.when(i != 3, (i * 10).cast("string")).alias("review_count"),
            F.col("p_brand").alias("address"),
        ),
    )
    graph = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("address"))
    payload = F.when(F.col("p_type") == "PROMO", F.to_json(F.struct(graph.alias("knowledge_graph")))).otherwise(
        F.to_json(F.struct(items.alias("local_results")))
    )
    return p.select(F.col("p_partkey").alias("request_id"), payload.alias("payload"))


# --- messages, logs and responses -------------------------------------------------------------

def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a closing remark that depends on the turn."""
    c = costly(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    remark = (
        F.when(F.col("turn") == 0, F.concat(F.lit(" What is the rating of BKG_"), conv, F.lit(" in London?")))
        .when(F.col("turn") == 1, " The wifi and Parking near Kuala Lumpur are fine.")
        .when(F.col("turn") == 2, F.concat(F.lit(" Compare abb_"), conv, F.lit(" with bkg_"), conv, F.lit(" in paris")))
        .when(F.col("turn") == 3, " The breakfast in Rome and London was good.")
        .otherwise("")
    )
    return c.withColumn("text", F.concat("text", remark))


MESSAGES_SQL = r"""
messages AS (
  SELECT conv_id, turn, role, text || CASE turn
      WHEN 0 THEN ' What is the rating of BKG_' || conv_id || ' in London?'
      WHEN 1 THEN ' The wifi and Parking near Kuala Lumpur are fine.'
      WHEN 2 THEN ' Compare abb_' || conv_id || ' with bkg_' || conv_id || ' in paris'
      WHEN 3 THEN ' The breakfast in Rome and London was good.' ELSE '' END AS text
  FROM conversations)
"""

KNOWN_TOOLS = ["search_reviews", "rank_by_metric", "search_weather", "search_events", "get_topic"]


def tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = costly(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit('<function=search_reviews {"query": "wifi '), k, F.lit('", "k": '), k, F.lit("}'")))
        .when(kind == "click", F.concat(F.lit('I call <function=rank_by_metric>{"metric": "price", "k": "'), k, F.lit('"}</function> now')))
        .when(kind == "error", F.concat(F.lit('<function=other_tool {"x": '), k, F.lit("}</function>")))
        .when(kind == "signup", F.concat(F.lit('<function=search_weather {"days": "'), value, F.lit('", "city": "Rome", "flag": "True", "raw": false}</function>')))
        .otherwise(F.concat(F.lit('<function=search_events {bad json}</function> then <function=get_topic {"topics": ["wifi", "noise"], "limit": '), value, F.lit("}")))
    )
    return e.select(F.col("event_id").alias("message_id"), text.alias("text"))


TOOL_LOGS_SQL = r"""
tool_logs AS (
  SELECT event_id AS message_id, CASE event_type
    WHEN 'view' THEN '<function=search_reviews {"query": "wifi ' || (props->>'$.k') || '", "k": ' || (props->>'$.k') || '}'''
    WHEN 'click' THEN 'I call <function=rank_by_metric>{"metric": "price", "k": "' || (props->>'$.k') || '"}</function> now'
    WHEN 'error' THEN '<function=other_tool {"x": ' || (props->>'$.k') || '}</function>'
    WHEN 'signup' THEN '<function=search_weather {"days": "' || CAST(value AS VARCHAR) || '", "city": "Rome", "flag": "True", "raw": false}</function>'
    ELSE '<function=search_events {bad json}</function> then <function=get_topic {"topics": ["wifi", "noise"], "limit": ' || CAST(value AS VARCHAR) || '}' END AS text
  FROM events),
tool_found AS (
  SELECT message_id,
    list_concat(regexp_extract_all(text, '(?s)<function=(\w+)\s*(\{[^}]+\})\s*(?:</function>|<function>)?', 1),
                regexp_extract_all(text, '(?s)<function=(\w+)>\s*(\{[^}]+\})\s*</function>', 1)) AS tools,
    list_concat(regexp_extract_all(text, '(?s)<function=(\w+)\s*(\{[^}]+\})\s*(?:</function>|<function>)?', 2),
                regexp_extract_all(text, '(?s)<function=(\w+)>\s*(\{[^}]+\})\s*</function>', 2)) AS args
  FROM tool_logs),
tool_calls AS (
  SELECT message_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY i) - 1 AS INTEGER) AS call_no, tool, args_json
  FROM (SELECT message_id, unnest(tools) AS tool, unnest(args) AS args_json, unnest(range(len(tools))) AS i FROM tool_found)
  WHERE tool IN ('search_reviews', 'rank_by_metric', 'search_weather', 'search_events', 'get_topic') AND json_valid(args_json))
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn after the first as a response that quotes and rephrases the turn before it."""
    c = costly(spark, sf_dir, "conversations")
    earlier = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    turns = c.join(earlier, ["conv_id", "turn"])
    response = F.concat(
        "text", F.lit(" Many guests mention "), "before",
        F.lit('. They wrote "'), F.replace("before", F.lit('"'), F.lit("")), F.lit('" and "'),
        F.replace("text", F.lit('"'), F.lit("")), F.lit('". Rating: '), F.col("turn").cast("string"),
        F.when(F.col("role") == "user", ". According to reviews, guests reported noise; no information found")
        .otherwise(". Search results show it. Several people complained"), F.lit("."),
    )
    return turns.select(
        "conv_id", "turn", response.alias("response"),
        F.array("before", F.concat(F.lit("no rating, score: "), (F.col("turn") - 1).cast("string"))).alias("outputs"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = costly(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")

    def rating(shift: int):
        return F.pmod(k + shift, F.lit(6))

    return e.select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("comments"),
        rating(0).alias("relevance_rating"), rating(1).alias("accuracy_rating"),
        F.when(F.col("event_type") != "view", rating(2)).alias("actionability_rating"),
        rating(3).alias("speed_rating"), rating(4).alias("overall_rating"),
        F.when(F.col("event_type") != "error", k > 50).alias("would_use_again"),
        F.col("value").alias("elapsed_seconds"),
    )


FEEDBACK_SQL = r"""
feedback AS (
  SELECT user_id AS session_id, ts, event_type, CAST(props->>'$.k' AS INTEGER) AS k,
         CAST(props->>'$.k' AS INTEGER) % 6 AS relevance, (CAST(props->>'$.k' AS INTEGER) + 1) % 6 AS accuracy,
         CASE WHEN event_type <> 'view' THEN (CAST(props->>'$.k' AS INTEGER) + 2) % 6 END AS actionability,
         (CAST(props->>'$.k' AS INTEGER) + 3) % 6 AS speed, (CAST(props->>'$.k' AS INTEGER) + 4) % 6 AS overall,
         CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS INTEGER) > 50 END AS would_use_again,
         value AS elapsed_seconds
  FROM events)
"""


def scenario_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = costly(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("scenario_id"), kind.alias("category"),
        F.when(kind == "view", "review_analyst").when(kind == "click", "competitor_analyst, benchmark_agent")
        .otherwise("market_intel").alias("expected_agent"),
        F.when(F.col("user_id") > 70, "benchmark_agent,review_analyst").otherwise("market_intel ,x").alias("agent_used"),
        F.when(kind == "signup", F.lit(None)).when(F.col("value") > 30, F.concat(F.lit("Unknown tool was asked for, sorry, here is all I know about "), "props"))
        .when(F.col("value") > 5, F.concat(F.lit("A long and friendly answer about your property and "), "props"))
        .otherwise("short").alias("response"),
        F.when(kind != "signup", F.col("value")).alias("elapsed_seconds"),
    )


SCENARIO_RUNS_SQL = r"""
scenario_runs AS (
  SELECT event_id AS scenario_id, event_type AS category, user_id, value, event_type,
         CASE WHEN event_type = 'view' THEN user_id > 70 WHEN event_type = 'click' THEN user_id > 70
              ELSE user_id <= 70 END AS routing_correct,
         event_type <> 'signup' AND value <= 30 AND value > 5 AS success,
         CASE WHEN event_type <> 'signup' THEN value END AS elapsed_seconds
  FROM events)
"""
