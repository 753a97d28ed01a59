"""Least cost and least audit of conversation repairs against exhaustive search."""

import functools
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from innsight.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(initials, gone, extra):
    """Every edit sequence with up to two inserted turns before a row, by recursion."""
    n = len(initials)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.lru_cache(None)
    def rest(i, state, inserted):
        ways = [(0, "")] if i == n and state in ("", "a") else []
        steps = [(2, "I", i, after[state, c], inserted + 1) for c in "ua" if (state, c) in after and inserted < 2]
        if i < n:
            steps.append((3, "D", i + 1, state, 0))
            if not gone[i]:
                steps += [(2 + extra[i], "R", i + 1, after[state, c], 0) for c in "ua" if (state, c) in after]
                if (state, initials[i]) in after:
                    steps.append((extra[i], "K", i + 1, after[state, initials[i]], 0))
        for cost, letter, j, there, count in steps:
            found = rest(j, there, count)
            if found is not None:
                ways.append((cost + found[0], letter + found[1]))
        return min(ways, default=None)

    return rest(0, "", 0)


def test_cheapest_edits_equal_exhaustive_search():
    rng = random.Random(5)
    for _ in range(4000):
        n = rng.randint(0, 9)
        initials = [rng.choice(["s", "u", "a", "a", "u", "t", ""]) for _ in range(n)]
        gone = [rng.random() < 0.15 for _ in range(n)]
        extra = [int(rng.random() < 0.3) for _ in range(n)]
        got = repair.cheapest_edits(repair.Lattice(initials, gone, extra))
        assert got == exhaustive(tuple(initials), tuple(gone), tuple(extra)), (initials, gone, extra)


def test_long_conversation():
    rng = random.Random(6)
    initials = [rng.choice("uuuaas") for _ in range(5000)]
    cost, audit = repair.cheapest_edits(repair.Lattice(initials, [False] * 5000, [0] * 5000))
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    assert cost == sum(price[a] for a in audit) and sum(a != "I" for a in audit) == 5000


def by_hand(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = exhaustive(tuple(initials), tuple(f in ("blank", "duplicate") for f in faults), tuple(int(f == "truncated") for f in faults))
    turns = sorted({t for t, _, _ in rows if t is not None})
    return (
        turns[-1] - turns[0] + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
        faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
    )


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_query_equals_damage_and_repair_by_hand(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    conversations = {}
    for r in given.collect():
        rows = conversations.setdefault(r.conv_id, [])
        role, text = r.role if r.role is not None else " ", r.text if r.text is not None else " "
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        rows += [(r.turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    got = {r.conv_id: r for r in queries.op13_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(conversations)
    for conv_id, rows in conversations.items():
        r = got[conv_id]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == by_hand(ordered(rows))
    assert any("R" in r.audit for r in got.values()) and any("I" in r.audit for r in got.values())


def test_repaired_turns_fit_the_pattern(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
        (2, 0, "assistant", "First."), (3, 5, "system", "Be brief."), (3, 7, "tool", "Data."), (3, 8, "assistant", "cut off"),
        (4, None, "user", "Q?"), (4, 1, None, None), (4, 2, "assistant", "\t\n "), (5, 0, "", "no role."),
        (None, 0, "user", "Null id."), (None, 1, "assistant", "Fine."), (6, 0, "user", "gone"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("there", F.col("conv_id").isNull() | (F.col("conv_id") != 6))
    for name in ("audit", "cost", "gaps", "repaired", "_1"):
        frame = frame.withColumn(name, F.lit("x"))
    got = {r.conv_id: r for r in repair.repair_conversations(frame, there_col="there").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    for conv_id, r in got.items():
        own = ordered([(t, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv_id and c != 6])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == by_hand(own)
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.repaired))
    assert (got[6].audit, got[6].repaired, got[6].cost) == ("", [], 0)
    assert got[None].audit == "KK" and got[3].gaps == 1 and got[4].gaps == 0
    assert repair.repair_conversations(frame.limit(0)).count() == 0


def test_damage_of_nulls_and_repeats(spark):
    rows = [(i, None if i % 3 == 0 else i % 7, None if i % 5 == 0 else "assistant", None if i % 4 == 0 else "One. Two!") for i in range(200)]
    rows.append((None, 1, "user", "x."))
    out = queries.damaged_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        want += [(c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text, h != 0)] * (2 if h == 3 else 1)
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256("\n".join([]).encode()).hexdigest()
