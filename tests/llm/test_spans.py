"""Repeated passages that runs of three sentences of enough words do not reach."""

import numpy as np

from innsight.llm import spans

DOCS = "doc_id long, text string"


def words(seed, n):
    return [f"w{i}" for i in np.random.default_rng(seed).integers(0, 10**6, n)]


def cleaned(spark, rows):
    return {r.doc_id: r.text for r in spans.remove_repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}


def test_passages_of_short_sentences_are_removed(spark):
    shouts = " ".join(w + "!!" for w in words(1, 60))
    menu = "\n".join(words(2, 60))
    rows = [(i, " ".join(words(10 + i, 20)) + f".\n{shouts}\n{menu}\n" + " ".join(words(20 + i, 20)) + ".") for i in range(4)]
    got = cleaned(spark, rows)
    assert got[0] == rows[0][1]
    for i in range(1, 4):
        assert got[i].split() == [*(" ".join(words(10 + i, 20)) + ".").split(), *(" ".join(words(20 + i, 20)) + ".").split()]


def test_texts_under_one_id_have_their_own_places(spark):
    passage = ". ".join(" ".join(words(30 + i, 8)) for i in range(8)) + "."
    short = ". ".join(" ".join(words(50 + i, 8)) for i in range(3)) + "."
    long = ". ".join(" ".join(words(60 + i, 8)) for i in range(9)) + ". " + passage
    frame = spark.createDataFrame([(1, passage), (2, short), (2, long), (2, long)], DOCS)
    got = sorted(r.text for r in spans.remove_repeated_spans(frame).where("doc_id = 2").collect())
    assert got == sorted([short, *[long.removesuffix(passage)] * 2])


def test_passages_that_start_inside_sentences_are_removed(spark):
    rows, wanted = [], {}
    for k, n in enumerate((51, 60, 75, 140)):
        passage = " ".join(words(70 + k, n))
        for i in range(6):
            before, after = (" ".join(words(100 * (k + 1) + 10 * i + j, 5 + 4 * i)) for j in (0, 5))
            rows.append((10 * k + i, f"{before} {passage} {after}."))
            wanted[10 * k + i] = rows[-1][1] if not i else f"{before} {after}."
    assert cleaned(spark, rows) == wanted


def test_passages_without_blanks_are_removed(spark):
    def signs(seed, n):
        return "".join(chr(0x4E00 + i) for i in np.random.default_rng(seed).integers(0, 5000, n))

    rows = [(i, signs(100 + i, 30) + signs(1, 80) + signs(200 + i, 30)) for i in range(3)]
    wanted = {i: text if not i else signs(100 + i, 30) + signs(200 + i, 30) for i, text in rows}
    assert cleaned(spark, rows) == wanted


def test_one_repeated_sentence_stays(spark):
    line = " ".join(words(3, 30)) + "."
    rows = [(i, f"{' '.join(words(300 + i, 20))}. {line} {' '.join(words(400 + i, 20))}.") for i in range(4)]
    assert cleaned(spark, rows) == dict(rows)


def test_no_window_of_51_words_is_left_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in spans.remove_repeated_spans(docs).collect()}

    def repeats(texts):
        seen, n = set(), 0
        for i in sorted(texts):
            w = (texts[i] or "").casefold().split()
            for window in (tuple(w[k : k + 51]) for k in range(len(w) - 50)):
                n += window in seen
                seen.add(window)
        return n

    assert repeats(before) > 1000 and repeats(after) == 0
    # what goes occurred before, so no word is lost altogether
    gone = [i for i in before if before[i] != after[i]]
    assert gone and min(before) not in gone
    vocabulary = {w for t in after.values() for w in (t or "").casefold().split()}
    assert vocabulary == {w for t in before.values() for w in (t or "").casefold().split()}
