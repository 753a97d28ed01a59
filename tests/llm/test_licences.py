"""The licence scan on planted notices, near misses and awkward rows."""

from pyspark.sql import functions as F

from innsight.llm import licences
from innsight.llm.licences import NOTICES, Lookup, split_words

FILLER = "the quick onthe thing and of a software in any form may be used with care "


def scan(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in licences.scan(docs, **more).collect()}


def test_every_notice_is_found_where_it_stands(spark):
    rows = [(k, FILLER * 2 + text.upper() + "\n" + FILLER) for k, (_, text, _) in enumerate(NOTICES)]
    rows += [(k, FILLER * (k % 7)) for k in range(100, 160)]
    got = scan(spark, rows)
    for k, (label, text, _) in enumerate(NOTICES):
        notice = next(n for n in got[k].notices if n.label == label and n.length == len(split_words(text)))
        assert (notice.first_word, notice.share) == (len(split_words(FILLER * 2)), 1.0) and got[k].score == 1.0
        assert label in got[k].labels and set(got[k].base_labels) <= set(got[k].labels)
    assert all(got[k].labels == [] and got[k].score == 0.0 for k in range(100, 160))


def test_rare_words_must_agree_and_phrases_must_stand(spark):
    words = split_words(NOTICES[5][1])
    scattered = " filler word here ".join(reversed(words))
    changed = "Permission is hereby denied, free of charge, to any person obtaining a copy of this software and associated documentation files"
    shifted = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated big documentation files"
    got = scan(spark, [(1, scattered), (2, changed), (3, shifted), (4, "by nc cc licensed under 4 0")])
    assert got[1].notices == [] and got[2].notices == [] and got[4].notices == []
    assert [n.label for n in got[3].notices] == ["mit"] and got[3].score < 1.0


def test_base_phrases_count_every_place(spark):
    text = "MIT License, mit-license! The apache\nLICENSE; mit xlicense general public\tlicense mİt license"
    got = scan(spark, [(1, text), (2, "license mit"), (3, "mit"), (4, "license")])
    assert [(p.first_word, p.label) for p in got[1].places] == [(0, "mit"), (2, "mit"), (5, "apache"), (9, "gpl")]
    assert got[1].base_labels == ["apache", "gpl", "mit"] and got[1].score >= 0.5 and got[1].n_words == 14
    assert all(got[k].labels == [] for k in (2, 3, 4))


def test_cut_notice_at_the_edges_of_a_text(spark):
    got = scan(spark, [(1, "under the MIT License."), (2, "x Released under the MIT"), (3, "under CC BY-NC 4.0")])
    assert [n.first_word for n in got[1].notices] == [-1] and got[1].notices[0].share == 0.8
    assert got[2].notices == []
    assert got[3].labels == ["cc-by-nc"] and got[3].notices[0].first_word == -1


def test_frequency_orders_the_look_up(spark):
    """One word is looked up: the rarest. Common numbers far away mislead only while they are rare."""
    text = "licensed under cc by nc " + "some filler here " * 10 + "4 0"
    only = Lookup(rare=1, agree=1, slack=0)
    assert scan(spark, [(9, text)], lookup=only)[9].notices == []
    got = scan(spark, [(9, text)] + [(k, "4 0") for k in range(3)], lookup=only)
    assert [(n.label, n.first_word) for n in got[9].notices] == [("cc-by-nc", 0)]


def test_awkward_rows(spark):
    long = FILLER * 20_000 + "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, " \n.\t"), (4, "Released under the MIT License."), (4, "Released under the MIT License."),
            (None, "Licensed under CC BY-NC 4.0."), (5, long), (6, "漢 été licenseé")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("words", "present", "places", "labels", "score", "n_words", "active"):
        docs = docs.withColumn(name, F.lit("x"))
    got = licences.scan(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].n_words for k in (1, 2, 3, 6)] == [0, 0, 0, 3]
    assert all(by_id[k].labels == [] and by_id[k].score == 0.0 for k in (1, 2, 3, 6))
    assert [r.labels for r in got if r.doc_id == 4] == [["mit"]] * 2
    assert by_id[None].labels == ["cc-by-nc"] and by_id[5].labels == ["mit"]
    assert by_id[5].places[0].first_word == by_id[5].n_words - 2
    assert licences.scan(docs.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
