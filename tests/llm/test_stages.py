"""Stages of the pipeline on labels that teach nothing, on long texts, on null and repeated ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from innsight.llm import toxicity
from tests.llm.test_edges import DOCS, awkward, brute_groups, prose


@pytest.mark.parametrize("rows", [[], [(1, 1, 1), (2, 1, 1), (3, 1, 1)], [(1, 1, 0), (2, 1, 0)]])
def test_labels_that_teach_nothing_keep_all(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = awkward(spark)
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)


def test_a_text_that_does_not_fit_is_passed_over(spark):
    settings = toxicity.Settings(sample_rows=20, sample_bytes=2000)
    order = [r.id for r in spark.range(60).orderBy(F.xxhash64("id"), "id").collect()]
    sizes = {i: 100 for i in order} | {order[0]: 5000, order[1]: 5000, order[5]: 1900}
    docs = spark.createDataFrame([(i, chr(97 + i % 26) * n) for i, n in sizes.items()], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    texts, classes = toxicity.training_sample(docs, labels, settings, "doc_id", "text", "toxic")
    for value in (0, 1):
        own = [i for i in order if i % 2 == value and sizes[i] <= 2000][:20]
        wanted, total = [], 0
        for i in own:
            if total + sizes[i] <= 2000:
                total += sizes[i]
                wanted.append(chr(97 + i % 26) * sizes[i])
        assert sorted(t for t, c in zip(texts, classes, strict=True) if c == value) == sorted(wanted)
        assert len(wanted) > 15


def test_one_row_of_each_group_with_null_and_repeated_ids(spark):
    near = prose(21).split()
    rows = [tuple(r) for r in awkward(spark).collect()] + [
        (None, prose(1), "en", "a", 1), (None, prose(4), "en", "a", 2),  # copies, but without an id
        (20, " ".join(near), "en", "a", 1), (20, " ".join(near), "de", "b", 1), (20, prose(22), "en", "a", 1),
        (21, " ".join([*near, "more"]), "en", "a", 1), (21, prose(23), "en", "a", 1), (21, None, "en", "a", 1),
        (22, prose(23), "en", "a", 1), (19, prose(22), "en", "a", 1), (23, prose(30), "en", "a", 1),
        (23, " ".join([*prose(30).split(), "more"]), "en", "a", 1),
    ]
    known = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=str)
    # each different text under its own number, in the order of the ids
    numbers = {pair: i for i, pair in enumerate(sorted(known, key=lambda p: p[0]))}
    groups = brute_groups([(i, text) for (_, text), i in numbers.items()], 5, 80)
    component = {number: group for number, _, group in groups}
    wanted = {(pair[0], component[i]) for pair, i in numbers.items() if component[i] == i}
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r.text for r in kept if r.doc_id is None)) == sorted(r[1] for r in rows if r[0] is None)
    found = [(r.doc_id, component[numbers[r.doc_id, r.text]]) for r in kept if r.doc_id is not None]
    assert sorted(found) == sorted(wanted)


def test_unique_ids_keep_the_smallest_of_each_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({group for _, _, group in groups})
