"""Nulls, empty tables, ties, repeats, clashing names and hot groups, operator by operator."""

import gc
import hashlib
import math
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from innsight.llm import chat, hilbert, jaccard, packing, pieces, risk_rules, spans, tokens, topk, toxicity, training_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(0, n, 8):
        out.append(" ".join(rng.choice(WORDS, 8)) + ".")
    return " ".join(out)


def awkward(spark):
    base = prose(1)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail one.", "en", None, None),
        (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n\t", "de", "b", 3), (7, "one", "de", "b", 3),
        (8, prose(2), None, "c", -5), (8, prose(2), None, "c", -5), (9, prose(3, 20_000), "fr", "c", 10**12),
        (None, prose(4), "en", "a", 2), (10, "###\\</turn>   é 漢 \x00", "en", "a", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The frame with columns named like those of results and helpers."""
    for name in ("score", "kept", "shard", "slot", "n_words", "component_id", "removed", "sequence_id", "key", "label", "_id2"):
        df = df.withColumn(name, F.lit("x"))
    return df


def labels(spark, column):
    rows = [(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (99, 1), (8, 0)]
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


# --- 1

def brute_top_k(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted(((-int(np.dot(v, w)), i) for i, w in rows if i != q))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [3, 700])
def test_top_k_equals_brute_force_with_ties(spark, size):
    rng = np.random.default_rng(size)
    data = [(i, [int(x) for x in rng.integers(-9, 9, 12)] if i % 3 else [1] * 12) for i in range(size)]
    rows = spark.createDataFrame(data, "vec_id long, vector array<long>")
    found = topk.top_k(rows, rows.where("vec_id % 10 = 0"), 5, block=128, query_block=16)
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute_top_k(data, [d for d in data if d[0] % 10 == 0], 5)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, 0.1]), (2, None), (3, [0.5, nan]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [0.5, 0.1]),
            (5, [0.5, 0.1]), (6, []), (7, [1e6, 1e6]), (50, [1.0, 1.0]), (8, [None, 1.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    rows = rows.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    got = [(r.id, r.score) for r in topk.top_k(rows, rows.where("vec_id = 50"), 9).orderBy("rank").collect()]
    assert got == [(7, 256 * 512_000_000), (1, 256 * 153), (5, 256 * 153), (5, 256 * 153), (6, 0)]
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(0, 30, (2000, 8)))
    vectors[5] = 500
    ids = np.arange(2000)
    query = np.abs(np.floor(rng.normal(0, 30, (1, 8))))
    (at, scores), = topk.nra_block(query, np.array([-1]), vectors, ids, 5)
    exact = vectors @ query[0]
    assert list(at) == list(np.lexsort((ids, -exact))[:5]) and list(scores) == [int(x) for x in exact[at]]


# --- 2

def test_pieces_edges(spark):
    df = pieces.encode_texts(clashing(awkward(spark)), pieces.default_model())
    library = pieces.Pieces(pieces.default_model()).library
    for r in pieces.decode_ids(df, pieces.default_model()).collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    both = pieces.encode_texts(clashing(awkward(spark)), pieces.default_model(), decoded="decoded").collect()
    apart = pieces.decode_ids(df, pieces.default_model()).collect()
    assert sorted((r.ids, r.decoded) for r in both) == sorted((r.ids, r.decoded) for r in apart)
    assert pieces.encode_texts(empty(spark), pieces.default_model()).count() == 0


def test_unigram_scores_equal_the_library():
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if piece.type == 1:
            piece.score = -math.log(i + 2.0) - (i % 97) / 1000
    unigram = pieces.Pieces(proto=model.SerializeToString())
    texts = [prose(i).replace("w", "the quick brown foxes jump over ")[:3000] for i in range(20)]
    for text, ids in zip(texts, unigram.encode(texts), strict=True):
        assert ids.tolist() == unigram.library.encode(text)


# --- 3

def test_spans_edges(spark):
    df = awkward(spark)
    got = {}
    for r in spans.remove_repeated_spans(clashing(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].text == prose(1) and got[2][0].text == "" and got[3][0].text.strip() == "tail one."
    assert got[4][0].text is None and got[5][0].text == "" and got[6][0].text == " \n\t"
    assert [r.text for r in got[8]] == [prose(2)] * 2 and got[None][0].text == prose(4)
    assert spans.remove_repeated_spans(empty(spark)).count() == 0


def test_a_passage_in_many_documents_stays_once(spark):
    passage = prose(77, 64)
    rows = [(i, f"{prose(100 + i, 24)}\n{passage}\n{prose(500 + i, 24)}", "en", "a", 1) for i in range(60)]
    got = {r.doc_id: r.text for r in spans.remove_repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 60):
        assert passage not in got[i] and prose(100 + i, 24) in got[i] and prose(500 + i, 24) in got[i]


def test_one_long_sentence_is_cut():
    text = " ".join(WORDS[:70])
    cut = spans.sentences(text, 16)
    assert "".join(cut) == text and len(cut) == 5


# --- 4

def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        order = hilbert.hilbert_index(grid, bits)
        assert sorted(order) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(order)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_shards_edges_and_pruning(spark, tmp_path):
    got = hilbert.assign_shards(clashing(awkward(spark)), 4, ["lang", "source", "n_chars"]).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 12 and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert hilbert.assign_shards(empty(spark), 4, ["lang", "n_chars"]).count() == 0
    grid = spark.range(4096).selectExpr("id doc_id", "id % 64 x", "id div 64 y")
    placed = hilbert.assign_shards(grid, 16, ["x", "y"])
    hilbert.write_shards(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    spread = back.groupBy("shard").agg((F.max("x") - F.min("x")).alias("x"), (F.max("y") - F.min("y")).alias("y"))
    assert back.count() == 4096 and all(r.x <= 32 and r.y <= 32 for r in spread.collect())


# --- 5

def test_word_buckets_together():
    settings = toxicity.Settings()
    words = ["", "x", "ab", "<>", "!!!", "\u00e9t\u00e9", "\u65e5\u672c\u8a9e", "h\u00e9\U0001f600a", "\ud800x", "straight-forward", "it's", "x"]
    found, owner = toxicity.buckets_of(words, settings)
    for i, word in enumerate(words):
        assert found[owner == i].tolist() == toxicity.word_buckets(word, settings)
    assert len(toxicity.buckets_of([], settings)[0]) == 0


def test_words_are_weighed_in_bounded_memory():
    settings = toxicity.Settings()
    weights = np.random.default_rng(3).normal(size=settings.buckets)
    words = [f"word-number-{i}" for i in range(60_000)]
    tracemalloc.start()
    try:
        got = toxicity.word_weights(words, weights, settings)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40_000_000  # all words at once took ten times that
    for i in (0, 3_999, 4_000, 59_999):
        assert got[i] == pytest.approx(weights[toxicity.word_buckets(words[i], settings)].mean())
    assert len(toxicity.word_weights([], weights, settings)) == 0


def test_toxicity_edges(spark):
    model = toxicity.learnt(awkward(spark), labels(spark, "toxic"))
    got = toxicity.scored(clashing(awkward(spark)), model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(empty(spark), model).count() == 0
    none = toxicity.learnt(empty(spark), labels(spark, "toxic"))
    assert toxicity.scored(awkward(spark), none).where("score <> 0.5").count() == 0


def test_unseen_misspellings_score_high():
    texts = [prose(i, 40) + (" you horrible villain" if i % 2 else "") for i in range(1500)]
    model = toxicity.train(texts, np.arange(1500) % 2)
    weights = model.weights

    def word(w):
        return weights[toxicity.word_buckets(w, model.settings)].mean()

    ordinary = [word(w) for w in WORDS]
    assert word("horribble") > max(ordinary) and word("villlain") > max(ordinary)


# --- 6

def brute_groups(rows, words, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations([i for i, s in enumerate(sets) if s and rows[i][0] is not None], 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(top(i)) if r[0] is not None else None) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, words, percent):
    rng = np.random.default_rng(words)
    rows = [tuple(r) for r in awkward(spark).collect()]
    for family in range(6):
        base = prose(1000 + family, 60 + 60 * family).split()
        for _ in range(25):
            text = list(base)
            for _ in range(rng.integers(0, 1 + len(base) // 30)):
                text[rng.integers(len(text))] = f"edit{rng.integers(1000)}"
            rows.append((len(rows) + 100, " ".join(text), "en", "a", 1))
    rows += [(900 + i, " ".join(WORDS[i : i + 8 + i % 3]), "en", "a", 1) for i in range(30)]
    got = jaccard.near_duplicate_groups(clashing(spark.createDataFrame(rows, DOCS)), words, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(rows, words, percent)


def test_groups_of_nothing(spark):
    assert jaccard.near_duplicate_groups(empty(spark)).count() == 0


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        y = np.unique(np.r_[x[rng.integers(20):], rng.integers(0, 2**63, 10).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        differ = int(np.bitwise_count((jaccard.bitmap(x) ^ jaccard.bitmap(y)).view(np.uint64)).sum())
        assert both <= (len(x) + len(y) - differ) // 2


# --- 7

def test_chat_edges(spark):
    nasty = ["\\### Assistant: </turn> ok", "####", "#\\##", "</turn", "\\", "a\nb", "", "<\\/turn></turn>", "##\\#", "###"]
    rows = [(1, 0, "user", nasty[0]), (1, 1, "assistant", "fine"), (2, None, None, None), (2, 0, "tool: x#", "y"),
            (None, 0, "user", "hi"), (3, 0, "assistant", "first"), (4, 0, "user", "tie"), (4, 0, "user", "tie"),
            (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "x" * 200_000)]
    rows += [(6, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    out = chat.format_conversations(turns).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    for conv, r in got.items():
        said = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in r.read] == [(t[2] or "", t[3] or "") for t in said]
        assert r.loss == "".join(t[3] for t in said if t[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert [got[c].valid for c in (1, 2, 3, 4, 5, 6)] == [True, False, False, False, True, True]
    assert chat.format_conversations(turns.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


# --- 8

def test_packing_edges(spark):
    rows = packing.pack_documents(clashing(awkward(spark)), tokens.default_vocabulary(), ids=True).collect()
    assert Counter(r.doc_id for r in rows)[4] == 1 and next(r for r in rows if r.doc_id == 4).length == 1
    for r in rows:
        assert len(r.ids) == 4 * r.length
    lengths, starts = Counter(), {}
    for r in rows:
        lengths[r.sequence_id] += r.length
        starts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert max(lengths.values()) <= 2048
    for places in starts.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
    assert packing.pack_documents(empty(spark), tokens.default_vocabulary()).count() == 0


def test_least_squares_is_not_negative_and_fits():
    matrix = np.array([[2.0, 0, 1], [0, 1, 1]])
    x = packing.nnls(matrix, np.array([10.0, 3.0]), 2000)
    assert (x >= 0).all() and np.allclose(matrix @ x, [10, 3], atol=1e-3)


def test_pieces_without_ids_never_carry_them(spark):
    vocabulary = tokens.default_vocabulary()
    whole = packing.cut_documents(awkward(spark), vocabulary)
    lean = packing.cut_documents(awkward(spark), vocabulary, ids=False)
    assert lean.columns == [c for c in whole.columns if c != "ids"]
    assert sorted(lean.collect(), key=str) == sorted(whole.drop("ids").collect(), key=str)


# --- 9

@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_feistel_is_a_permutation(size):
    first = training_order.feistel(np.arange(size), size, 7)
    assert sorted(first) == list(range(size))
    assert size < 64 or list(first) != list(training_order.feistel(np.arange(size), size, 8))


def test_training_order_edges(spark, tmp_path):
    index = training_order.materialise(clashing(awkward(spark)), str(tmp_path / "a"), tokens.default_vocabulary(), 64, 10)
    rows = index.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and not [r for r in rows if r.doc_id in (4, 5, 6)]
    assert training_order.materialise(empty(spark), str(tmp_path / "b"), tokens.default_vocabulary()).count() == 0


def test_records_are_left_to_the_files_to_compress(spark):
    rows = training_order.sequences(awkward(spark), tokens.default_vocabulary(), 64, 7).collect()
    assert {len(r.ids) for r in rows} == {128} and all(r.ids[2 * r.length :] == b"\x07\x00" * (64 - r.length) for r in rows)


def test_records_of_a_shard_are_shuffled_as_one_compressed_piece(spark):
    line = np.arange(256).astype("<u2").tobytes()
    rows = [(i % 7, 0, 256, line, 999 - i, (999 - i) // 500, (999 - i) % 500) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, start long, length int, ids binary, slot long, shard int, record long").coalesce(1)
    pieces = training_order.packed(table).collect()
    assert sorted(p.shard for p in pieces) == [0, 1]
    for p in pieces:
        assert len(p.rows) < 500 * 512 // 4
        got = training_order.unpacked([bytes(p.rows)])
        assert got["slot"].to_pylist() == list(range(500 * p.shard, 500 * p.shard + 500))
        assert set(got["ids"].to_pylist()) == {line}


# --- 10

def _most_rejected(spark, n, rate, error):
    from pyspark.sql import functions as F

    trials = spark.createDataFrame([(n,)], "n long")
    return trials.select(risk_rules.most_rejected(F.col("n"), rate, F.lit(error)).alias("k")).first().k


def test_binomial_limit_is_exact(spark):
    for n, rate, error in ((500, 0.01, 0.01), (2000, 0.002, 0.0025), (40, 0.01, 0.05), (1, 0.5, 0.6)):
        k = _most_rejected(spark, n, rate, error)

        def tail(k):
            return sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))

        assert (k == -1 or tail(k) <= error) and tail(k + 1) > error
    assert _most_rejected(spark, 0, 0.01, 0.05) == -1


def test_rules_edges(spark):
    got = risk_rules.judged(clashing(awkward(spark)), labels(spark, "quality")).collect()
    assert len(got) == 12 and all(r.kept != r.base_failed for r in got)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[4].n_words, by_id[5].n_words, by_id[6].n_words, by_id[7].n_words) == (0, 0, 0, 1)
    assert by_id[10].n_symbols == 5 and by_id[9].kept
    assert risk_rules.judged(empty(spark), labels(spark, "quality")).count() == 0


def test_cutoffs_reject_junk_and_keep_the_promise(spark):
    good = [(i, prose(i), "en", "a", 1) for i in range(1500)]
    junk = [(5000 + i, prose(9000 + i).replace(" ", "$$$ "), "en", "a", 1) for i in range(100)]
    docs = spark.createDataFrame(good + junk, DOCS)
    marks = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in junk], "doc_id long, quality int")
    out = risk_rules.judged(docs, marks, risk_rules.Risk(rate=0.05)).select("doc_id", "kept").collect()
    assert all(not r.kept for r in out if r.doc_id >= 5000)
    assert sum(not r.kept for r in out if r.doc_id < 5000) <= 0.05 * 1500


def test_one_path_finds_cutoffs_on_given_labels(spark):
    import duckdb
    from innsight.llm import queries

    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = {r[0]: r[6:] for r in con.execute(queries.SQL["op10_quality_rules"]).fetchall()}
    got = {r.doc_id: (r.base_failed, r.kept) for r in queries.op10_quality_rules(spark, folder).collect()}
    assert got == want
    assert sum(not failed and not kept for failed, kept in got.values()) > 100


def test_levels_and_cutoffs_equal_a_plain_count(spark):
    from pyspark.sql import functions as F

    rows = [(i, "en" if i % 3 else None, i * 7919 % 61, 1) for i in range(3000)] + [(9000 + i, "xx", 0, 1) for i in range(20)]
    held = spark.createDataFrame(rows, "doc_id long, lang string, n_marks long, good int").select(
        "*", F.lit(100).cast("long").alias("n_words"), F.lit(200).cast("long").alias("word_chars"), F.lit(1).cast("long").alias("n_lines"),
        *[F.lit(0).cast("long").alias(c) for c in ("n_symbols", "n_repeat_words", "n_dup_lines", "n_capitals")],
    )
    found = {r.stratum: r for r in risk_rules.cutoffs(held, "lang", "good", risk_rules.Risk(rate=0.02)).collect()}
    assert set(found) == {"en", None, "xx"} and (found["xx"].allowed, found["xx"].cutoff) == (-1, None)
    for name in ("en", None):
        levels = [marks * 10000 // (200 * 50) for _, lang, marks, _ in rows if lang == name]
        best = next(c for c in range(1, 101) if sum(x >= c for x in levels) <= found[name].allowed)
        assert (found[name].n_good, found[name].cutoff) == (len(levels), best) and found[name].allowed > 0


# --- tokens


_SHAPES = ["{}", "{},", "({})", "{}'s", "{}!?", "x{}9", "{}é", "{}\u0007", "A{}", "{}-{}", "'{}", " {}", "{}</w>", "日{}"]


def test_few_known_words_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "_WORDS", 60)
    monkeypatch.setattr(tokens, "_PARTS", 40)
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdeT"), rng.integers(1, 9))) for _ in range(300)]
    texts = [
        " ".join(_SHAPES[rng.integers(len(_SHAPES))].replace("{}", names[rng.integers(300)]) for _ in range(40)) for _ in range(60)
    ] + [None, "", "  \n ", "<|x|> a", "..."]
    own = tokens.WordTokenizer(tokens.default_vocabulary())
    for start in range(0, len(texts), 5):
        part = texts[start : start + 5]
        for text, ids in zip(part, own.encode_column(pa.array(part, pa.string())), strict=True):
            assert ids.tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_known_words_take_little_memory():
    own = tokens.WordTokenizer(tokens.default_vocabulary())
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, (100_000, 9)).astype(np.uint8)
    words = pa.array([" ".join(w.tobytes().decode() for w in letters)], pa.string())
    tracemalloc.start()
    own.encode_column(words)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 * len(letters)  # bytes


# --- near duplicates of the pipeline, and its driver's memory


def test_two_sets_are_compared_once_and_never_with_themselves(spark):
    one, near, far = prose(1), prose(1) + " w1", prose(2)
    docs = spark.createDataFrame([(1, one), (2, one), (3, near), (4, near), (5, far)], "doc_id long, text string")
    sets = jaccard._payload(docs, 5)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (3, 4), (1, 5)], "a long, b long")
    digest = {r.doc_id: r.digest for r in sets.collect()}
    assert [tuple(r) for r in jaccard._linked(pairs, sets, 80).collect()] == [(digest[1], digest[3])]


def test_training_counts_some_texts_at_once(monkeypatch):
    texts = [prose(k, 40) + (" bad" if k % 2 else " good") * 3 for k in range(60)] + ["", None, "  "]
    classes = np.array([k % 2 for k in range(63)])
    whole = toxicity.train(texts, classes)
    held, counted = [], toxicity._counted
    monkeypatch.setattr(toxicity, "_BLOCK", 1000)
    monkeypatch.setattr(toxicity, "_counted", lambda part, s: held.append(sum(map(len, part))) or counted(part, s))
    small = toxicity.train(texts, classes)
    assert max(held) <= 1000 and sum(held) == 2 * sum(len(t) for t in texts[:60])
    assert (small.embeddings == whole.embeddings).all() and (small.softmax == whole.softmax).all() and not whole.empty
