"""Similarity search, look-ups and rankings over documents."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import AIRBNB_PREFIX, BOOKING_PREFIX, PRICE_TEXT_PATTERN, RATING_TEXT_PATTERN
from innsight.functions import text as tx
from innsight.functions import vectors
from innsight.operators.metric_index import TIE_DIGITS, best_columns, unit_rows
from innsight.operators.topics import flatten_vectors, mentions_keyword
from innsight.sources.shared import stored

# Up to so many queries travel to the executors with the function and the corpus stays where it
# is; more are dealt in blocks that meet blocks of the corpus, with the same result.
MAX_QUERIES = 10_000
QUERY_CHUNK = 256
BLOCK_ROWS = 4096
#: How many times longer the next part of a city's list is, for names that need more of it.
WIDER = 8


def _best_of(queries: np.ndarray, corpus: np.ndarray, names: np.ndarray, k: int):
    """(query, positions, similarities) of the best ``k`` rows of ``corpus`` for each query.

    Queries are scored in chunks, so that never more than a few MB of scores are held.
    """
    for start in range(0, len(queries), QUERY_CHUNK):
        scores = np.round(queries[start:start + QUERY_CHUNK] @ corpus.T, TIE_DIGITS)
        for line, picked in best_columns(scores, k, names):
            yield start + line, picked, scores[line, picked]


def _found(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    kinds = (pa.string(), pa.string(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=["query_id", "doc_id", "similarity"]
    )


def _partition_search(asked: dict[tuple, tuple[list[str], np.ndarray]], k: int):
    """Arrow function over the batches of one task; yields the task's best k per query.

    ``asked`` has the query ids and unit vectors for each set of filter values. Rows are told
    apart by dictionary codes of their filter columns.
    """
    def groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        columns = [batch.column(i).dictionary_encode() for i in range(2, batch.num_columns)]
        if not columns:
            yield (), np.arange(batch.num_rows)
            return
        codes = np.stack([c.indices.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        kinds, member = np.unique(codes, axis=0, return_inverse=True)
        order = np.argsort(member.ravel(), kind="stable")
        parts = np.split(order, np.cumsum(np.bincount(member.ravel(), minlength=len(kinds)))[:-1])
        values = [c.dictionary.to_pylist() for c in columns]
        for kind, rows in zip(kinds, parts):
            yield tuple(v[code] for v, code in zip(values, kind)), rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[float, str]]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            corpus = flatten_vectors(batch.column(1))
            norms = np.linalg.norm(corpus, axis=1)
            for key, rows in groups(batch):
                rows = rows[norms[rows] > 0]
                if key not in asked or rows.size == 0:
                    continue
                names, (query_ids, matrix) = ids[rows], asked[key]
                for q, picked, scores in _best_of(matrix, corpus[rows] / norms[rows][:, None], names, k):
                    found = [(-float(s), names[p]) for s, p in zip(scores, picked)]
                    best[query_ids[q]] = heapq.nsmallest(k, best.get(query_ids[q], []) + found)
        yield _found([(q, doc, -minus) for q, found in best.items() for minus, doc in found])

    return search


def _block_search(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Every block of queries meets every block of the corpus that has the same filter values."""
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias(name))

    sizes = blocks(queries, "chunks").join(blocks(corpus, "blocks"), keys)

    def own(count: str, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    place = [*keys, "block", "chunk"]
    again = sizes.select(*keys, F.expr("chunks + 0").alias("n_chunks"), F.expr("blocks + 0").alias("n_blocks"))
    asked = queries.join(sizes, keys).withColumn("chunk", own("chunks", "query_id")).withColumn("block", every("blocks"))
    known = corpus.join(again, keys).withColumn("block", own("n_blocks", "doc_id")).withColumn("chunk", every("n_chunks"))
    asked, known = asked.select(*place, "query_id", "vector"), known.select(*place, "doc_id", "vector")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            ids, names = left["query_id"].to_pylist(), np.array(right["doc_id"].to_pylist(), dtype=object)
            for q, picked, scores in _best_of(unit_rows(left["vector"]), unit_rows(right["vector"]), names, k):
                rows.extend((ids[q], names[p], float(s)) for s, p in zip(scores, picked))
        return pa.Table.from_batches([_found(rows)])

    return asked.groupBy(*place).cogroup(known.groupBy(*place)).applyInArrow(
        score, "query_id string, doc_id string, similarity double"
    )


def search_top_k(
    queries: DataFrame, corpus: DataFrame, k: int = 5, match_on: Sequence[str] = (), vector_col: str = "vector"
) -> DataFrame:
    """The ``k`` most similar documents per query: ``(query_id, doc_id, similarity, rank)``.

    ``queries`` holds ``query_id``, a vector and a value for each column of ``match_on``,
    which a document has to equal; values are compared in the type of the corpus, and null
    equals nothing. Only documents with a wanted value are looked at. Up to ``MAX_QUERIES``
    queries go to the corpus: every task keeps its own best k per query, and only those are
    shuffled for the final rank. More queries meet the corpus in blocks.
    """
    kinds = dict(corpus.dtypes)
    keys = [f"_key{i}" for i in range(len(match_on))]

    def usable(df: DataFrame, id_col: str) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        rows = df.select(
            F.col(id_col).cast("string").alias(id_col), vector.alias("vector"),
            *[F.col(c).cast(kinds[c]).alias(key) for c, key in zip(match_on, keys)],
        )
        return rows.filter(F.col("vector").isNotNull()).dropna(subset=keys) if keys else rows.filter("vector is not null")

    asked = usable(queries, "query_id").filter(vectors.l2_norm(F.col("vector")) > 0)
    known = usable(corpus, "doc_id")
    if keys:
        known = known.join(asked.select(*keys).distinct(), keys, "left_semi")
    known = known.select("doc_id", "vector", *keys)
    rows = asked.limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        one = [F.lit(0).alias("_key")] if not keys else []
        usable_rows = known.filter(vectors.l2_norm(F.col("vector")) > 0)
        found = _block_search(asked.select("*", *one), usable_rows.select("*", *one), keys or ["_key"], k)
    else:
        grouped: dict[tuple, tuple[list, list]] = {}
        for r in rows:
            ids, matrix = grouped.setdefault(tuple(r[key] for key in keys), ([], []))
            ids.append(r["query_id"])
            matrix.append(r["vector"])
        units = {
            key: (ids, np.array(m, dtype=float) / np.linalg.norm(np.array(m, dtype=float), axis=1, keepdims=True))
            for key, (ids, m) in grouped.items()
        }
        found = known.mapInArrow(_partition_search(units, k), "query_id string, doc_id string, similarity double")
    window = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def hotel_namespace(hotel_id: Column, kind: str = "hotels") -> Column:
    """Where a hotel's documents live, by its prefix; unknown prefixes count as booking."""
    return F.when(hotel_id.startswith(AIRBNB_PREFIX + "_"), f"airbnb_{kind}").otherwise(f"booking_{kind}")


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of a length; none where the text is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def _maybe_asked(pieces: DataFrame, asked: DataFrame, bits: int = 1 << 20) -> DataFrame:
    """Pieces that may be among the asked ones; a join on the piece has to follow.

    The asked pieces set bits of a table of ``bits`` bits, however many they are, so its broadcast
    is bounded; all others are dropped within their task, before any shuffle.
    """
    place = F.pmod(F.xxhash64("namespace", "gram"), F.lit(bits))
    table = asked.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_bits")
    )
    met = pieces.withColumn("_p", place).join(F.broadcast(table), F.shiftright("_p", 6) == F.col("_word"))
    return met.filter("shiftright(_bits, cast(_p % 64 as int)) & 1L = 1").drop("_p", "_word", "_bits")


def lookup_hotels(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """The document of each requested hotel by id, else the first whose title contains its name.

    ``requests`` holds ``hotel_id`` and ``hotel_name``; every row comes back once. Names the id
    did not answer are joined with titles on the rarest of their three-letter pieces (shorter
    names on themselves) and then compared in full, so any number of them can be asked for;
    pieces of titles that no name holds are dropped before they are shuffled.
    """
    docs = documents.filter(F.col("namespace").isin("booking_hotels", "airbnb_hotels"))
    wanted = requests.select("hotel_id", "hotel_name").distinct().withColumn(
        "namespace", hotel_namespace(F.col("hotel_id"))
    )
    by_id = wanted.join(docs.select("namespace", "hotel_id", "title", "text"), ["namespace", "hotel_id"], "left")
    answered = by_id.filter(F.col("text").isNotNull()).select(
        "hotel_id", F.col("hotel_id").alias("found_hotel_id"), "title", "text", F.lit("id").alias("found_by")
    ).dropDuplicates(["hotel_id"])
    missing = by_id.filter(F.col("text").isNull()).select(
        "hotel_id", "namespace", F.lower("hotel_name").alias("name")
    ).filter(F.length("name") > 0)
    titles = docs.filter(F.col("title").isNotNull()).select(
        "namespace", F.col("hotel_id").alias("found_hotel_id"), F.lower("title").alias("lowered")
    )
    pieces = titles.select(
        "*", F.explode(F.concat(*[F.coalesce(_grams(F.col("lowered"), F.lit(n)), F.array()) for n in (1, 2, 3)])).alias("gram")
    )
    asked = missing.select("*", F.explode(_grams(F.col("name"), F.least(F.lit(3), F.length("name")))).alias("gram"))
    pieces = _maybe_asked(pieces, asked)
    frequent = pieces.groupBy("namespace", "gram").agg(F.count("*").alias("n"))
    rarest = (
        asked.join(frequent, ["namespace", "gram"], "left")
        .groupBy("hotel_id", "namespace", "name")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
        .filter("least.n > 0")
        .select("hotel_id", "namespace", "name", F.col("least.gram").alias("gram"))
    )
    first = (
        rarest.join(pieces, ["namespace", "gram"])
        .filter(F.contains("lowered", "name"))
        .groupBy("hotel_id", "namespace").agg(F.min("found_hotel_id").alias("found_hotel_id"))
    )
    by_name = first.join(
        docs.select("namespace", F.col("hotel_id").alias("found_hotel_id"), "title", "text"), ["namespace", "found_hotel_id"]
    ).select("hotel_id", "found_hotel_id", "title", "text", F.lit("name").alias("found_by"))
    found = answered.unionByName(by_name.dropDuplicates(["hotel_id"]))
    return requests.select("hotel_id").join(found, "hotel_id", "left")


def hotel_reviews(
    requests: DataFrame, corpus: DataFrame, k: int = 3, vector_col: str = "vector"
) -> DataFrame:
    """Reviews of each requested hotel nearest to its query vector.

    The namespace follows the id's prefix; hotels that are not from booking and have no
    reviews there are looked for among the airbnb reviews. Both places are searched in one
    pass and the first that has reviews is kept.
    """
    hotel = F.col("hotel_id")
    first = hotel_namespace(hotel, "reviews")
    places = F.when(
        ~hotel.startswith(BOOKING_PREFIX + "_") & (first != "airbnb_reviews"),
        F.array(first, F.lit("airbnb_reviews")),
    ).otherwise(F.array(first))
    spread = requests.select(
        "query_id", "hotel_id", vector_col, F.posexplode(places).alias("place", "namespace")
    )
    keyed = spread.withColumn("query_id", F.concat_ws("\u0001", F.col("query_id").cast("string"), "place"))
    found = search_top_k(keyed, corpus, k, ["namespace", "hotel_id"], vector_col)
    parts = F.split("query_id", "\u0001")
    placed = found.select(
        parts[0].alias("query_id"), parts[1].cast("int").alias("place"), "doc_id", "similarity", "rank"
    )
    window = Window.partitionBy("query_id")
    return (
        placed.withColumn("_first", F.min("place").over(window))
        .filter(F.col("place") == F.col("_first"))
        .select("query_id", "doc_id", "similarity", "rank")
    )


def split_by_topic(
    reviews: DataFrame, keywords_col: str = "keywords", keys: Sequence[str] = ("query_id",),
    max_relevant: int = 8, max_other: int = 3, few: int = 3,
    order: Sequence[str] = ("rank",), text_col: str = "text",
) -> DataFrame:
    """Mark reviews as relevant or other and keep what a report shows.

    At most eight relevant ones; three others, and only when fewer than three are relevant.
    """
    marked = reviews.withColumn("relevant", mentions_keyword(F.col(text_col), F.col(keywords_col)))
    window = Window.partitionBy(*keys, "relevant").orderBy(*order)
    # the plain limit lets every task drop rows of a hot group before they are shuffled
    numbered = marked.withColumn("position", F.row_number().over(window)).filter(
        (F.col("position") <= max(max_relevant, max_other))
        & (F.col("position") <= F.when(F.col("relevant"), max_relevant).otherwise(max_other))
    )
    counts = marked.groupBy(*keys).agg(F.count_if("relevant").alias("n_relevant"))
    return numbered.join(counts, list(keys)).filter(F.col("relevant") | (F.col("n_relevant") < few))


def city_competitors(requests: DataFrame, documents: DataFrame, k: int = 5, shortlist: int = 50) -> DataFrame:
    """The first ``k`` hotels of each request's city, booking first, without the hotel itself.

    An answer depends on the city and the name alone, so each name of a city is answered once.
    It meets the head of its city's list; a name that leaves too few of that meets a head
    ``WIDER`` times as long, and so on to the whole city, so what is tried grows with the place
    of a name's last answer and not with the city.
    """
    hotels = stored(documents.filter(F.col("namespace").isin("booking_hotels", "airbnb_hotels")).select(
        F.lower("city").alias("city_key"), F.col("hotel_id").alias("competitor_id"),
        F.col("title").alias("competitor"),
        F.when(F.col("namespace") == "booking_hotels", 0).otherwise(1).alias("place"),
    ), "city-hotels")
    asked = stored(requests.select("hotel_id", F.lower("hotel_name").alias("own_name"), F.lower("city").alias("city_key")), "city-requests")
    order = ("place", "competitor_id", "competitor")
    city = Window.partitionBy("city_key").orderBy(*order)
    per_name = Window.partitionBy("city_key", "own_name").orderBy(*order)
    sizes = stored(hotels.groupBy("city_key").agg(F.count("*").alias("n_city")), "city-sizes")

    # a name that is null is contained in nothing and has no answer
    names = asked.where("own_name is not null").select("city_key", "own_name").distinct().join(sizes, "city_key")
    names = stored(names, "city-names")
    answers: list[DataFrame] = []
    length = shortlist
    while True:
        head = hotels.withColumn("_n", F.row_number().over(city)).filter(F.col("_n") <= length).drop("_n")
        answer = (
            names.join(head, "city_key")
            .filter(~F.contains(F.lower("competitor"), F.col("own_name")))
            .withColumn("_found", F.row_number().over(per_name))
            .filter(F.col("_found") <= k)
        )
        answer = stored(answer.select("city_key", "own_name", *order), "city-answers")
        reached = answer.groupBy("city_key", "own_name").agg(F.count("*").alias("n_found"))
        short = names.filter(F.col("n_city") > length).join(reached, ["city_key", "own_name"], "left")
        short = stored(short.filter(F.coalesce("n_found", F.lit(0)) < k).select("city_key", "own_name", "n_city"), "city-names")
        answers.append(answer.join(short, ["city_key", "own_name"], "left_anti"))
        if not short.limit(1).count():
            break
        names, length = short, length * WIDER
    found = answers[0]
    for answer in answers[1:]:
        found = found.unionByName(answer)

    per_request = Window.partitionBy("hotel_id").orderBy(*order)
    source = F.when(F.col("place") == 0, "Booking.com").otherwise("Airbnb")
    return (
        asked.join(found, ["city_key", "own_name"])
        .withColumn("position", F.row_number().over(per_request))
        .filter(F.col("position") <= k)
        .select("hotel_id", "position", "competitor_id", "competitor", source.alias("source"))
    )


def rating_metric(rating: Column, text: Column) -> Column:
    """Rating from the metadata unless missing or zero, else from the text."""
    known = F.when(rating != 0, rating.cast("double"))
    return F.coalesce(known, F.regexp_extract(text, RATING_TEXT_PATTERN, 1).try_cast("double"))


def price_metric(price: Column, text: Column) -> Column:
    """Price from the metadata with ``$`` and ``,`` removed, else from the text."""
    known = F.regexp_replace(price.cast("string"), r"[$,]", "").try_cast("double")
    return F.coalesce(
        F.when(known != 0, known), F.regexp_extract(text, PRICE_TEXT_PATTERN, 1).try_cast("double")
    )


def rank_by_metric(
    hotels: DataFrame, metric: str, k: int = 10, own_name: str | None = None, value_col: str = "value"
) -> DataFrame:
    """The ``k`` best hotels by a metric: price upwards, anything else downwards.

    Hotels without a value are left out; ties go to the smaller id. Each task keeps its own
    best k, so no global sort takes place.
    """
    direction = F.asc(value_col) if metric == "price" else F.desc(value_col)
    top = hotels.filter(F.col(value_col).isNotNull()).orderBy(direction, "hotel_id").limit(k)
    window = Window.orderBy(direction, "hotel_id")
    mine = F.contains(F.lower("title"), F.lit(own_name.lower())) if own_name else F.lit(False)
    return top.select(
        F.row_number().over(window).alias("position"), "hotel_id", "title", value_col, mine.alias("is_mine")
    )


def sentiment_digest(reviews: DataFrame, keys: Sequence[str] = ("hotel_id", "topic")) -> DataFrame:
    """Counts by label per hotel and topic, and the overall impression.

    Positive or Negative when one side outweighs the other two to one, else Mixed.
    """
    counted = reviews.groupBy(*keys).agg(
        F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
        F.count("*").alias("reviews"),
    )
    overall = (
        F.when(F.col("positive") > 2 * F.col("negative"), "Positive")
        .when(F.col("negative") > 2 * F.col("positive"), "Negative")
        .otherwise("Mixed")
    )
    return counted.withColumn("overall", overall)


def capped_text(df: DataFrame, limits: dict[str, tuple[int, str]]) -> DataFrame:
    """Cut text columns to their budgets: ``{column: (characters, mark)}``."""
    for name, (limit, mark) in limits.items():
        df = df.withColumn(name, tx.cap(F.col(name), limit, mark))
    return df
