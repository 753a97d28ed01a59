"""Repair of a conversation's turn structure at least cost, with the edits written down.

A conversation should run ``(system)? (user assistant)+`` or be empty. Edits, row by row: Keep
costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2; a
truncated row that stays adds 1. Blank and duplicate rows have to go.

A node of the edit lattice is (rows consumed, state of the role pattern). Dijkstra runs from the
empty start and, over reversed edges, from the finished ends at once. It goes on until the two
heaps' least costs add up to more than the best meeting, so every crossing of that cost between
the settled halves is known. The least audit is then read letter by letter through the tight
edges of the forward half, the crossings and the tight edges of the reverse half. No audit of
least cost begins another one, so the set of nodes that share the least letters so far is enough;
time and memory grow with the conversation, not with its square.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State of the pattern: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (2, 2, 3, 2)
FINAL = (0, 3)
#: States from which the next turn leads to a state.
BEFORE = ((), (), (0, 1, 3), (2,))
FOLLOWS = {"su", "ua", "au"}

RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired array<struct<role: string, text: string>>"
)
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


class Lattice:
    """Edges between the nodes ``4 * rows + state`` of one conversation."""

    def __init__(self, initials: list[str], gone: list[bool], extra: list[int]):
        self.initials, self.gone, self.extra, self.n = initials, gone, extra, len(initials)

    def _kept(self, i: int, state: int) -> int:
        """The state after keeping row ``i``, or -1."""
        first = self.initials[i]
        if first == "s":
            return 1 if state == 0 else -1
        return NEXT_STATE[state] if first == NEXT_ROLE[state][0] else -1

    def out(self, node: int) -> list[tuple[int, str, int]]:
        i, state = divmod(node, 4)
        to = [(INSERT, "I", 4 * i + NEXT_STATE[state])]
        if i < self.n:
            to.append((DELETE, "D", node + 4))
            if not self.gone[i]:
                to.append((REROLE + self.extra[i], "R", 4 * i + 4 + NEXT_STATE[state]))
                kept = self._kept(i, state)
                if kept >= 0:
                    to.append((KEEP + self.extra[i], "K", 4 * i + 4 + kept))
        return to

    def into(self, node: int) -> list[tuple[int, str, int]]:
        i, state = divmod(node, 4)
        of = [(INSERT, "I", 4 * i + s) for s in BEFORE[state]]
        if i:
            of.append((DELETE, "D", node - 4))
            if not self.gone[i - 1]:
                of += [(REROLE + self.extra[i - 1], "R", 4 * i - 4 + s) for s in BEFORE[state]]
                of += [(KEEP + self.extra[i - 1], "K", 4 * i - 4 + s) for s in range(4) if self._kept(i - 1, s) == state]
        return of


def cheapest_edits(lattice: Lattice) -> tuple[int, str]:
    """The least cost and, among all edits of that cost, the least audit."""
    goals = [4 * lattice.n + s for s in FINAL]
    reached: tuple[dict[int, int], dict[int, int]] = ({0: 0}, dict.fromkeys(goals, 0))
    settled: tuple[dict[int, int], dict[int, int]] = ({}, {})
    forward, reverse = settled
    heaps = ([(0, 0)], [(0, g) for g in goals])
    best = 0 if 0 in goals else float("inf")
    while True:
        # both ends are settled before anything else, so every best path has a crossing
        if 0 not in forward:
            side = 0
        elif goals[0] not in reverse or goals[1] not in reverse:
            side = 1
        elif heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
            side = int(heaps[0][0][0] > heaps[1][0][0])
        else:
            break
        cost, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side][node] = cost
        for step, _, other in lattice.into(node) if side else lattice.out(node):
            total = cost + step
            if total < reached[side].get(other, float("inf")):
                reached[side][other] = total
                heapq.heappush(heaps[side], (total, other))
                if other in reached[1 - side]:
                    best = min(best, total + reached[1 - side][other])

    def crossing(node: int) -> list[tuple[str, int]]:
        return [(a, v) for step, a, v in lattice.out(node) if v in reverse and forward[node] + step + reverse[v] == best]

    ready = [u for u, cost in forward.items() if cost + reverse.get(u, best + 1) == best or crossing(u)]
    leads = set(ready)
    while ready:
        v = ready.pop()
        for step, _, u in lattice.into(v):
            if u not in leads and u in forward and forward[u] + step == forward[v]:
                leads.add(u)
                ready.append(u)

    def met(node: int) -> bool:
        return node in reverse and forward[node] + reverse[node] == best

    audit = []
    left, right = {0}, {0} if met(0) else set()
    while not right & set(goals):
        ways: dict[str, tuple[set[int], set[int]]] = {}
        for u in left:
            for step, a, v in lattice.out(u):
                if v in leads and forward[u] + step == forward[v]:
                    to = ways.setdefault(a, (set(), set()))
                    to[0].add(v)
                    if met(v):
                        to[1].add(v)
            for a, v in crossing(u):
                ways.setdefault(a, (set(), set()))[1].add(v)
        for u in right:
            for step, a, v in lattice.out(u):
                if v in reverse and step + reverse[v] == reverse[u]:
                    ways.setdefault(a, (set(), set()))[1].add(v)
        letter = min(ways)
        audit.append(letter)
        left, right = ways[letter]
    return int(best), "".join(audit)


def repaired(rows: list[tuple[int | None, str, str]]) -> dict:
    """Faults, least cost, audit and repaired turns of one conversation's (turn, role, text), in order."""
    faults: list[str] = []
    seen: set[tuple[str, str]] = set()
    for _, role, text in rows:
        plain = text.strip(BLANK)
        if not plain:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if plain[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    lattice = Lattice(initials, [f in ("blank", "duplicate") for f in faults], [TRUNCATED * (f == "truncated") for f in faults])
    cost, audit = cheapest_edits(lattice)
    turns, at, state = [], 0, 0
    for letter in audit:
        if letter == "K":
            turns.append({"role": rows[at][1], "text": rows[at][2]})
            state = lattice._kept(at, state)
        elif letter != "D":
            turns.append({"role": NEXT_ROLE[state], "text": rows[at][2] if letter == "R" else ""})
            state = NEXT_STATE[state]
        at += letter != "I"
    numbers = {t for t, _, _ in rows if t is not None}
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        **{kind: faults.count(kind) for kind in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired": turns,
    }


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list]]:
    """(conversation, rows) from sorted batches; rows that are not there only name theirs."""
    current, rows, begun = None, [], False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "there", "turn", "role", "text")]
        for conv_id, there, *row in zip(*columns, strict=True):
            if begun and conv_id != current:
                yield current, rows
                rows = []
            current, begun = conv_id, True
            if there:
                rows.append(tuple(row))
    if begun:
        yield current, rows


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    there_col: str | None = None,
) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and the repaired turns.

    Rows are taken by turn, nulls first, then role and text, so ties and repeated rows have one
    order. A null role or text is one space. A row's first fault counts: ``blank`` (nothing but
    ASCII blanks), ``duplicate`` (role and text of an earlier row), ``truncated`` (not ended by
    one of ``.!?``). ``gaps`` counts turn numbers left out between the least and the greatest;
    null turns do not count. ``illegal`` counts adjacent rows whose roles' initials are not
    ``su``, ``ua`` or ``au``. A role without an initial of these cannot be kept. ``audit`` holds
    the edits' initials in order, the ASCII-least of all cheapest ones.

    ``there_col`` names a boolean column: rows where it is not true only say that their
    conversation exists. A conversation without rows has no faults and an empty repair. Rows with
    a null conversation id form one conversation; empty texts are blank; an empty table gives an
    empty result. Only the named columns are read.

    Conversations are shuffled once by id and sorted; a task holds the rows of one conversation at
    a time, which is what one output row holds as well. There is no limit on their length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        size = 0
        for conv_id, rows in _whole(batches):
            done.append({"conv_id": conv_id, **repaired(rows)})
            size += 200 + sum(len(text) for _, _, text in rows)
            if size > 1_000_000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    numbers = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([*[(c, pa.int64()) for c in numbers], ("audit", pa.string()), ("repaired", pa.list_(_TURN))])
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        (F.lit(True) if there_col is None else F.coalesce(F.col(there_col), F.lit(False))).alias("there"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(work, RESULT)
