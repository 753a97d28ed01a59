"""The operators' queries against their SQL, brute force, or exact round trips."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from innsight.llm import packing, pieces, queries, tokens, training_order
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, con, name):
    problem = compare(queries.QUERIES[name](spark, SF_DIR), con, queries.SQL[name])
    assert problem is None, problem


def test_sentencepiece_equals_the_library(spark, texts):
    library = pieces.Pieces(pieces.default_model()).library
    rows = queries.op2_sentencepiece(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id])
        assert r.round_trip and r.n_ids == len(r.ids)


def _windows_seen_before(texts, n):
    """Per document, which words stand in a window of ``n`` words that occurred at an earlier place."""
    seen, out = set(), {}
    for doc_id in sorted(texts):
        words = (texts[doc_id] or "").casefold().split()
        before = np.zeros(len(words), bool)
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                before[i : i + n] = True
            seen.add(window)
        out[doc_id] = (words, before)
    return out


def _is_subsequence(part, whole):
    rest = iter(whole)
    return all(w in rest for w in part)


def test_substring_dedup_equals_brute_force(spark, texts):
    """What must go is gone: windows of 51 words seen before. What must stay is there: all words in
    no window of 12 words seen before, in order, in their own spelling."""
    got = {r.doc_id: r.text for r in queries.op3_substring_dedup(spark, SF_DIR).collect()}
    assert set(got) == set(texts)
    assert not any(before.any() for _, before in _windows_seen_before(got, 51).values())
    assert any(before.any() for _, before in _windows_seen_before(texts, 51).values())
    for doc_id, (words, before) in _windows_seen_before(texts, 12).items():
        left = got[doc_id].casefold().split()
        assert _is_subsequence(left, words)
        assert _is_subsequence([w for w, x in zip(words, before, strict=True) if not x], left)
        if not before.any():
            assert got[doc_id] == texts[doc_id]
    assert any(got[d] != texts[d] for d in texts) and any(got[d] == texts[d] for d in texts)


def test_sharding_keeps_its_law(spark, texts):
    rows = queries.op4_sharding(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.grown_shard) == (len(data) + 1, zlib.crc32(data), None)


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = rows.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in held)
    assert len(held) > 50 and right / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.collect())


def test_packing_places_every_id_once(spark, texts):
    rows = queries.op8_packing(spark, SF_DIR).collect()
    encoder = tokens.WordTokenizer(tokens.default_vocabulary()).tokenizer
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.array([*encoder.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        used += at
    assert used / (2048 * len(by_sequence)) > 0.95


def test_training_order_is_a_permutation_that_reads_back(spark, tmp_path, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    folder = str(tmp_path / "shards")
    index = training_order.materialise(docs, folder, tokens.default_vocabulary(), stride=128, shard_rows=64).collect()
    by_slot = {r.slot: r for r in index}
    assert sorted(by_slot) == list(range(len(index)))
    encode = tokens.WordTokenizer(tokens.default_vocabulary()).encode
    whole = {d: np.frombuffer(encode(t), "<u2") for d, t in texts.items()}
    assert sum(r.length for r in index) == sum(map(len, whole.values()))
    for start in (0, 37, len(index) - 70):
        for k, record in enumerate(training_order.read_records(folder, start, 70, 64, 128)):
            r = by_slot[start + k]
            assert (r.shard, r.record) == divmod(r.slot, 64) and r.ids_crc32 == zlib.crc32(record.tobytes())
            assert (record[: r.length] == whole[r.doc_id][r.start : r.start + r.length]).all()
    order = [by_slot[s].doc_id for s in range(len(index))]
    assert order != sorted(order)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 1").collect()}
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF_DIR)
        assert frame.columns == docs.columns
        left = [r.doc_id for r in frame.select("doc_id").collect()]
        assert len(set(left)) == len(left) and set(left) < set(ids)
        frame = spark.createDataFrame(frame.collect(), docs.schema)
    assert not toxic & set(left)
    final = corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR)
    assert final.agg(F.count_distinct("doc_id")).first()[0] == len(left)


def test_combinations_fill_the_window():
    found = packing.combinations(12, 3)
    assert len(found) == len(set(found)) == 1 + 6 + 12
    assert all(sum(c) == 12 and list(c) == sorted(c, reverse=True) for c in found)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    histogram = np.r_[0, rng.integers(0, 500, 64)]
    used = np.zeros_like(histogram)
    for combo in packing.plan(histogram):
        assert sum(s * n for s, n in combo.pieces) <= 64 and combo.repeats > 0
        for size, count in combo.pieces:
            used[size] += count * combo.repeats
    assert (used == histogram).all()
