"""The operators' queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import (
    chat, hilbert, jaccard, licences, packing, pieces, repair, risk_rules, runs, spans, tokens, topk, toxicity, training_order,
)
from innsight.llm.work import stored
from innsight.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
) WHERE rank <= 5
""")
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    found = topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)
    return found.withColumnRenamed("id", "vec_id")


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_texts(docs, pieces.default_model(), decoded="decoded").select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )


@query()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeated_spans(docs).withColumn("n_removed", F.size("removed").cast("long"))


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = hilbert.assign_shards(docs, 16, ["lang", "source", "n_chars"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learnt(docs, table(spark, sf_dir, "labels"), learnable=~held_out)
    return toxicity.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


_SHINGLES = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= {n}
      THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * i >= {p} * (p.n + q.n - i)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


@query(_SHINGLES.format(n=3, p=90))
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


_SAID = "\\### Assistant: </turn> ok"


@query(r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    length(text) + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda h: (length(h) - 1) // 2)), 0)
      + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE length(role) + 7 END + 8 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM sized GROUP BY conv_id
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAID).alias("text"),
    )
    rows = chat.format_conversations(given.unionByName(added))
    read = rows.withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_vocabulary())


@query()
def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "training-order")
    return training_order.materialise(table(spark, sf_dir, "documents"), folder, tokens.default_vocabulary())


@query("""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g
  FROM words WHERE len(w) >= 3
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, p + k AS q FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id
), base AS (
  SELECT words.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_marks
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), levels AS (
  SELECT doc_id, lang, base_failed, least(100, greatest(
    CASE WHEN word_chars > 0 THEN n_symbols * 10000 // (word_chars * 50) ELSE 0 END,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // (n_words * 50) ELSE 0 END,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // (n_lines * 100) ELSE 0 END,
    CASE WHEN word_chars > 0 THEN n_capitals * 10000 // (word_chars * 100) ELSE 0 END,
    CASE WHEN word_chars > 0 THEN n_marks * 10000 // (word_chars * 50) ELSE 0 END)) AS level FROM judged
), holdout AS (
  SELECT lang, level FROM levels JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed
), strata AS (SELECT lang, count(*) AS n FROM holdout GROUP BY lang),
tails AS (
  SELECT lang, n, k, sum(p) OVER (PARTITION BY lang ORDER BY k) AS cdf FROM (
    SELECT lang, n, k, exp(lgamma(n + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END
        - CASE WHEN n = k THEN 0 ELSE lgamma(n - k + 1) END + k * ln(0.01) + (n - k) * ln(1 - 0.01)) AS p
    FROM (SELECT *, unnest(range(0, least(n, CAST(n * 0.01 * 4 + 50 AS BIGINT)))) AS k FROM strata))
), allowed AS (
  SELECT s.lang, coalesce(max(t.k), -1) AS k FROM strata s
  LEFT JOIN tails t ON t.lang IS NOT DISTINCT FROM s.lang AND t.cdf <= 0.05 / (SELECT count(*) FROM strata)
  GROUP BY s.lang
), cuts AS (
  SELECT a.lang, min(c.cut) AS cut FROM allowed a, (SELECT unnest(range(1, 101)) AS cut) c
  WHERE (SELECT count(*) FROM holdout h WHERE h.lang IS NOT DISTINCT FROM a.lang AND h.level >= c.cut) <= a.k
  GROUP BY a.lang
), rejected AS (
  SELECT s.doc_id FROM levels s JOIN cuts c ON c.lang IS NOT DISTINCT FROM s.lang AND s.level >= c.cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM judged
""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = stored(risk_rules.measures(docs).drop("text"), "measures")
    good = risk_rules.labelled_good(table(spark, sf_dir, "labels"))
    cuts = risk_rules.cutoffs(measured.join(good, measured["doc_id"] == good["_id"]), "lang", "_good")
    return risk_rules.judged_measures(measured, cuts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL: per character one exclusive or and eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    fold = "lambda c, e: CASE WHEN e < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, e) END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), {fold}), 4294967295)"


@query("""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o, """ + _crc32_sql("CAST(doc_id AS VARCHAR)") + """ AS h FROM documents
), planned AS (
  SELECT *, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM hashed
), damaged AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(o) > 0
    THEN list_transform(range(len(o)), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(o) - a) // (3 + g % 8)) END])
    ELSE o END AS w FROM planned
), placed AS (
  SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM damaged
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM placed x
  JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), found AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM found GROUP BY doc_id
), greatest_run AS (
  SELECT f.* FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND (g.length * f.period > f.length * g.period
      OR (g.length * f.period = f.length * g.period AND (g.start < f.start OR (g.start = f.start AND g.period < f.period)))))
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM found
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text
  FROM placed p LEFT JOIN dropped d ON d.doc_id = p.doc_id AND d.i = p.i WHERE d.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, g.start, CAST(g.length AS BIGINT) AS length, g.period,
  CAST(1000 * g.length // g.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM damaged d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN greatest_run g ON g.doc_id = d.doc_id
LEFT JOIN kept k ON k.doc_id = d.doc_id
""")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damaged_documents(table(spark, sf_dir, "documents"))
    found = runs.periodic_runs(damaged)
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate(F.slice("runs", 2, F.size("runs")), F.get("runs", F.lit(0)), lambda b, r: F.when(more(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text by hash repeats a block of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), risk_rules.BLANKS), "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    first, period = F.col("a").cast("int"), F.col("p").cast("int")
    repeated = F.transform("w", lambda w, i: F.when(i < first, w).otherwise(F.get("w", first + (i - first) % period)))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def _licence_sql() -> str:
    quoted = lambda values: ", ".join(f"({', '.join(str(v) if isinstance(v, int) else repr(v) for v in row)})" for row in values)
    words = [(k, i, w) for k, (_, text, _) in enumerate(licences.NOTICES) for i, w in enumerate(licences.split_words(text))]
    notices = [(k, label, len(licences.split_words(text))) for k, (label, text, _) in enumerate(licences.NOTICES)]
    phrases = [(k, f" {p} ") for k, (_, _, ps) in enumerate(licences.NOTICES) for p in ps]
    bases = [(label, f" {p} ", *licences.split_words(p)[:1]) for p, label in licences.PHRASES]
    look = licences.Lookup()
    return f"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), notices(notice, label, size) AS (VALUES {quoted(notices)}),
notice_words(notice, i, word) AS (VALUES {quoted(words)}),
phrases(notice, phrase) AS (VALUES {quoted(phrases)}),
bases(label, phrase, word) AS (VALUES {quoted(bases)}),
placed AS (
  SELECT doc_id, i, word FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM worded)
  WHERE word IN (SELECT word FROM notice_words UNION SELECT word FROM bases)
), present AS (SELECT DISTINCT doc_id, word FROM placed),
frequency AS (SELECT word, count(*) AS df FROM present GROUP BY word),
chosen AS (
  SELECT doc_id, notice, word FROM (
    SELECT p.doc_id, t.notice, p.word, row_number() OVER (PARTITION BY p.doc_id, t.notice ORDER BY f.df, p.word) AS rank
    FROM present p JOIN (SELECT DISTINCT notice, word FROM notice_words) t ON t.word = p.word JOIN frequency f ON f.word = p.word)
  WHERE rank <= {look.rare}
), beginnings AS (
  SELECT c.doc_id, c.notice, p.i - t.i AS at FROM chosen c
  JOIN placed p ON p.doc_id = c.doc_id AND p.word = c.word JOIN notice_words t ON t.notice = c.notice AND t.word = c.word
  GROUP BY c.doc_id, c.notice, p.i - t.i HAVING count(DISTINCT c.word) >= {look.agree}
), regions AS (
  SELECT b.doc_id, b.notice, b.at, n.label, n.size, d.w,
    ' ' || array_to_string(d.w[greatest(b.at - {look.slack}, 0) + 1 : greatest(b.at + n.size + {look.slack}, 0)], ' ') || ' ' AS region
  FROM beginnings b JOIN notices n ON n.notice = b.notice JOIN worded d ON d.doc_id = b.doc_id
), verified AS (
  SELECT * FROM regions r WHERE NOT EXISTS (SELECT 1 FROM phrases p WHERE p.notice = r.notice AND NOT contains(r.region, p.phrase))
), shares AS (
  SELECT v.doc_id, v.label, v.notice, v.at, CAST(count(*) FILTER (v.at + t.i >= 0 AND v.w[v.at + t.i + 1] = t.word) AS DOUBLE) / v.size AS share
  FROM verified v JOIN notice_words t ON t.notice = v.notice GROUP BY v.doc_id, v.label, v.notice, v.at, v.size
), places AS (
  SELECT p.doc_id, p.i, b.label FROM placed p JOIN bases b ON b.word = p.word JOIN worded d ON d.doc_id = p.doc_id
  WHERE ' ' || array_to_string(d.w[p.i + 1 : p.i + len(string_split(trim(b.phrase), ' '))], ' ') || ' ' = b.phrase
), based AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id
), labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM shares) GROUP BY doc_id
), scored AS (SELECT doc_id, max(share) AS share FROM shares GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
  coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  greatest(coalesce(s.share, 0.0), CASE WHEN b.n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM worded d LEFT JOIN based b ON b.doc_id = d.doc_id LEFT JOIN labelled l ON l.doc_id = d.doc_id LEFT JOIN scored s ON s.doc_id = d.doc_id
"""


@query(_licence_sql())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    """ + _crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + """ % 20 AS h
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hashed)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    trim(text, """ + _BLANKS + """) AS plain, left(role, 1) AS initial
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN plain = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(plain, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM numbered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
-- reach: from a state by up to two inserted turns, with the state, audit and turns added
reach(a, b, cost, audit, turns) AS (VALUES
  (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
moves AS (
  SELECT conv_id, i, NULL AS a, NULL AS b, 3 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS turns FROM faulty
  UNION ALL SELECT conv_id, i, s.a, s.b, 2 + CASE fault WHEN 'truncated' THEN 1 ELSE 0 END, 'R', [s.role || ':' || text]
    FROM faulty, (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) s(a, b, role)
    WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, s.a, s.b, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END, 'K', [role || ':' || text]
    FROM faulty, (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) s(a, b, initial)
    WHERE fault NOT IN ('blank', 'duplicate') AND s.initial = faulty.initial
),
best(conv_id, i, state, cost, audit, turns) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM faulty
  UNION ALL
  SELECT conv_id, i, state, cost, audit, turns FROM (
    SELECT t.conv_id, m.i, coalesce(m.b, r.b) AS state, t.cost + r.cost + m.cost AS cost, t.audit || r.audit || m.audit AS audit,
      list_concat(list_concat(t.turns, r.turns), m.turns) AS turns,
      row_number() OVER (PARTITION BY t.conv_id, coalesce(m.b, r.b) ORDER BY t.cost + r.cost + m.cost, t.audit || r.audit || m.audit) AS rank
    FROM best t JOIN reach r ON r.a = t.state JOIN moves m ON m.conv_id = t.conv_id AND m.i = t.i + 1 AND (m.a IS NULL OR m.a = r.b))
  WHERE rank = 1
), ends AS (
  SELECT t.conv_id, t.cost + r.cost AS cost, t.audit || r.audit AS audit, list_concat(t.turns, r.turns) AS turns,
    row_number() OVER (PARTITION BY t.conv_id ORDER BY t.cost + r.cost, t.audit || r.audit) AS rank
  FROM best t JOIN (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id) s ON s.conv_id = t.conv_id AND s.n = t.i
  JOIN reach r ON r.a = t.state AND r.b IN (0, 3)
)
SELECT g.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(e.cost, 0) AS BIGINT) AS cost,
  coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counted c ON c.conv_id = g.conv_id
LEFT JOIN ends e ON e.conv_id = g.conv_id AND e.rank = 1
""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = damaged_conversations(table(spark, sf_dir, "conversations"))
    lines = F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text))
    return repair.repair_conversations(given, there_col="there").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Rows with damage by a hash of conversation and turn; a dropped row stays with ``there`` false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("h") != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
