"""Exact nearest vectors by cosine within groups, without scoring every pair of blocks.

Angles between unit vectors are a metric. A group larger than a block gets pivots, a hashed share
of its own candidates; every vector belongs to its nearest pivot. A target first meets the
candidates of its own pivot. That gives a similarity that its k-th best cannot fall below, and the
triangle inequality then tells which other pivots can hold anything better: a candidate between
the angles ``lo`` and ``hi`` from a pivot is at least ``max(t - hi, lo - t)`` away from a target at
the angle ``t``. Targets are only copied to the blocks of pivots that are left. Results are those
of scoring all pairs; on vectors without any structure no pivot can be skipped, and the work is
that of all pairs in blocks.

Entries are ``(key, id, vec, is_target)``: a key's targets are compared with its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.sources.shared import stored

# Similarities are compared at this many digits, so that equal vectors tie whatever the
# order of summation was; ties go to the smaller id.
TIE_DIGITS = 9
#: Angles and similarities are only trusted to these margins when a block is skipped.
ANGLE_MARGIN, SIMILARITY_MARGIN = 1e-6, 1e-8
_ALONE = -1
#: Scores that a task holds at once.
SCORES = 1_000_000


def best_columns(scores: np.ndarray, k: int, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``scores`` the columns of its ``k`` best entries, best first."""
    width = scores.shape[1]
    for row in range(scores.shape[0]):
        line = scores[row]
        if width > k:
            floor = np.partition(line, width - k)[width - k]
            picked = np.flatnonzero(line >= floor)
        else:
            picked = np.arange(width)
        picked = picked[np.isfinite(line[picked])]
        yield row, picked[np.lexsort((ids[picked], -line[picked]))][:k]


def unit_rows(vectors_column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of an Arrow list column as rows of length one."""
    flat = pc.list_flatten(vectors_column).to_numpy()
    matrix = flat.reshape(len(vectors_column), -1)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


_SCORED = "key string, id string, near_id string, similarity double"


def _score_block(k: int, not_itself: bool):
    """Arrow function: targets and candidates of one block in, the best ``k`` per target out."""

    def score(rows: pa.Table) -> pa.Table:
        asked, known = rows.filter(pc.field("is_target")), rows.filter(~pc.field("is_target"))
        out: dict[str, list] = {"id": [], "near_id": [], "similarity": []}
        if asked.num_rows and known.num_rows:
            target_ids = np.array(asked["id"].to_pylist(), dtype=object)
            ids = np.array(known["id"].to_pylist(), dtype=object)
            targets, candidates = unit_rows(asked["vec"]), unit_rows(known["vec"])
            step = max(1, SCORES // len(ids))
            for start in range(0, len(target_ids), step):
                asking = target_ids[start:start + step]
                scores = np.round(targets[start:start + step] @ candidates.T, TIE_DIGITS)
                if not_itself:
                    scores[asking[:, None] == ids[None, :]] = -np.inf
                for row, picked in best_columns(scores, k, ids):
                    out["id"].extend([asking[row]] * len(picked))
                    out["near_id"].extend(ids[picked])
                    out["similarity"].extend(scores[row, picked])
        key = rows["key"][0].as_py() if rows.num_rows else ""
        return pa.table({
            "key": pa.array([key] * len(out["id"]), pa.string()), "id": pa.array(out["id"], pa.string()),
            "near_id": pa.array(out["near_id"], pa.string()), "similarity": pa.array(out["similarity"], pa.float64()),
        })

    return score


def _share(column: str, parts: Column, salt: str = "") -> Column:
    """A row's part out of ``parts``, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit(salt), column), parts).cast("int")


def _parts(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / F.lit(size)), F.lit(1)).cast("int")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def pivot_count(candidates: Column, block_rows: int) -> Column:
    """Expected pivots of a group: one per block, at most the root of its size; none for one block."""
    blocks = F.ceil(candidates / F.lit(block_rows))
    return F.when(blocks > 1, F.least(blocks, F.ceil(F.sqrt(candidates)))).otherwise(0)


def _nearest(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Entries with the number of their nearest pivot and the angle to it."""
    n = rows.num_rows
    if not n:
        rows = rows.slice(0, 0)
    if not n or not pivots.num_rows:
        chosen, angle = np.full(n, _ALONE), np.zeros(n)
    else:
        numbers = pivots["pivot"].to_numpy()
        cosine = np.clip(unit_rows(rows["vec"]) @ unit_rows(pivots["vec"]).T, -1.0, 1.0)
        best = cosine.argmax(axis=1)
        chosen, angle = numbers[best], np.arccos(cosine[np.arange(n), best])
    columns = [rows[c] for c in ("key", "id", "vec", "is_target")]
    return pa.table([*columns, pa.array(chosen, pa.int64()), pa.array(angle, pa.float64())], names=["key", "id", "vec", "is_target", "pivot", "angle"])


def placed_entries(entries: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Entries with pivot and angle, and the pivots ``(key, pivot, vec, lo, hi, subs, alone)``.

    Groups of one block have the one pivot ``-1``. ``subs`` is the number of blocks that a
    pivot's candidates are cut into, ``alone`` says that the group has no other block.
    """
    sizes = entries.groupBy("key").agg(
        F.count_if(~F.col("is_target")).alias("n_known"), F.count("*").alias("n_entries")
    ).where("n_known > 0 and n_known < n_entries").select(
        "key", "n_known", _parts(F.col("n_entries"), 4 * block_rows).alias("chunks"),
        pivot_count(F.col("n_known"), block_rows).alias("n_pivots"),
    )
    sized = entries.join(sizes, "key")
    small = sized.where("n_pivots = 0").select("key", "id", "vec", "is_target", F.lit(_ALONE).cast("long").alias("pivot"), F.lit(0.0).alias("angle"))
    large = sized.where("n_pivots > 0")
    number = F.xxhash64(F.lit("pivot"), "id")
    pivots = large.where(~F.col("is_target") & (F.pmod(number, F.col("n_known")) < F.col("n_pivots"))).select(
        "key", "vec", "chunks", number.alias("pivot")
    )
    # aliases: both sides of a cogroup come from one frame
    given = pivots.select(F.col("key").alias("key"), F.col("vec").alias("vec"), "pivot", _every("chunks").alias("chunk"))
    dealt = large.select("key", "id", "vec", "is_target", _share("id", F.col("chunks"), "chunk").alias("chunk"))
    near = dealt.groupBy("key", "chunk").cogroup(given.groupBy("key", "chunk")).applyInArrow(
        _nearest, "key string, id string, vec array<double>, is_target boolean, pivot long, angle double"
    )
    placed = stored(small.unionByName(near), "placed-vectors")
    blocks = placed.where(~F.col("is_target")).groupBy("key", "pivot").agg(
        F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")
    ).withColumn("subs", _parts(F.col("n"), block_rows))
    whole = blocks.groupBy("key").agg((F.sum("subs") == 1).alias("alone"))
    # two candidates with one hash would be one pivot twice
    vectors = pivots.groupBy("key", "pivot").agg(F.min("vec").alias("vec"))
    return placed, blocks.drop("n").join(whole, "key").join(vectors, ["key", "pivot"], "left")


def _own_block(placed: DataFrame, pivots: DataFrame, k: int, block_rows: int, not_itself: bool) -> DataFrame:
    """The best candidates of every target within one block of its own pivot."""
    asked = placed.where("is_target").groupBy("key", "pivot").agg(_parts(F.count("*"), block_rows).alias("turns"))
    sized = placed.join(pivots.select("key", "pivot", "subs").join(asked, ["key", "pivot"]), ["key", "pivot"])
    turn = F.when(F.col("is_target"), F.array(_share("id", F.col("turns"), "turn"))).otherwise(F.sequence(F.lit(0), F.col("turns") - 1))
    rows = sized.select("key", "pivot", "id", "vec", "is_target", _share("id", F.col("subs"), "sub").alias("sub"), F.explode(turn).alias("turn"))
    return rows.groupBy("key", "pivot", "sub", "turn").applyInArrow(_score_block(k, not_itself), _SCORED)


def _left(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Targets with the pivots that may hold something at least as near as their k-th best."""
    sizes, kept = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    if rows.num_rows and pivots.num_rows:
        numbers, lo, hi = (pivots[c].to_numpy() for c in ("pivot", "lo", "hi"))
        known = np.array([v is not None for v in pivots["vec"].to_pylist()])
        there = unit_rows(pivots.filter(pa.array(known))["vec"]) if known.any() else None
        bound = rows["bound"].to_numpy()[:, None] - SIMILARITY_MARGIN
        step = max(1, SCORES // len(numbers))
        for start in range(0, rows.num_rows, step):
            part = rows.slice(start, step)
            angle = np.zeros((part.num_rows, len(numbers)))
            if there is not None:
                angle[:, known] = np.arccos(np.clip(unit_rows(part["vec"]) @ there.T, -1.0, 1.0))
            apart = np.where(known, np.maximum(angle - hi, lo - angle), 0.0)
            reach = np.cos(np.clip(apart - ANGLE_MARGIN, 0.0, np.pi)) >= bound[start:start + step]
            sizes.append(reach.sum(axis=1))
            kept.append(numbers[np.nonzero(reach)[1]])
    rows = rows if rows.num_rows else rows.slice(0, 0)
    ends = np.cumsum(np.concatenate(sizes)) if len(kept) > 1 else np.zeros(rows.num_rows + 1, np.int64)
    others = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(kept), pa.int64()))
    return pa.table([rows["key"], rows["id"], rows["vec"], rows["pivot"], others], names=["key", "id", "vec", "pivot", "others"])


def reachable(placed: DataFrame, pivots: DataFrame, first: DataFrame, k: int, block_rows: int) -> DataFrame:
    """``(key, id, vec, pivot, sub)``: the blocks that a target still has to meet."""
    # fewer than k found so far exclude nothing
    bounds = first.groupBy("key", "id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(-2.0).alias("bound"))
    several = pivots.where(~F.col("alone"))
    asked = placed.where("is_target").join(several.select("key").distinct(), "key", "left_semi").join(bounds, ["key", "id"], "left")
    sizes = asked.groupBy("key").agg(_parts(F.count("*"), 4 * block_rows).alias("chunks"))
    dealt = asked.join(sizes, "key").select(
        "key", "id", "vec", "pivot", F.coalesce("bound", F.lit(-2.0)).alias("bound"), _share("id", F.col("chunks"), "chunk").alias("chunk")
    )
    given = several.join(sizes, "key").select(
        F.col("key").alias("key"), F.col("pivot").alias("pivot"), F.col("vec").alias("vec"), "lo", "hi", _every("chunks").alias("chunk")
    )
    left = dealt.groupBy("key", "chunk").cogroup(given.groupBy("key", "chunk")).applyInArrow(
        _left, "key string, id string, vec array<double>, pivot long, others array<long>"
    )
    met = left.select("key", "id", "vec", F.col("pivot").alias("own"), F.explode("others").alias("pivot"))
    blocks = met.join(several.select("key", "pivot", "subs"), ["key", "pivot"])
    spread = blocks.select("key", "pivot", "id", "vec", "own", "subs", _every("subs").alias("sub"))
    same = (F.col("pivot") == F.col("own")) & (F.col("sub") == _share("id", F.col("subs"), "sub"))
    return spread.where(~same).select("key", "id", "vec", "pivot", "sub")


def nearest(entries: DataFrame, k: int, block_rows: int = 4096, not_itself: bool = True) -> DataFrame:
    """``(key, id, near_id, similarity)``: candidates among which the ``k`` best of every target are.

    Per target and block only the best ``k`` are handed on; the caller ranks them. No group of
    rows that meet in a task is larger than about two blocks, whatever the size of a key. ``id``
    is a string, unique among a key's targets and among its candidates; vectors are not zero.
    """
    placed, pivots = placed_entries(entries, block_rows)
    pivots = stored(pivots, "pivots")
    first = stored(_own_block(placed, pivots, k, block_rows, not_itself), "first-neighbours")
    left = stored(reachable(placed, pivots, first, k, block_rows), "targets-left")
    return first.unionByName(_far(placed, pivots, left, k, block_rows, not_itself))


def _far(placed: DataFrame, pivots: DataFrame, left: DataFrame, k: int, block_rows: int, not_itself: bool) -> DataFrame:
    """The best candidates of targets in the blocks that they still have to meet."""
    known = placed.where(~F.col("is_target")).join(pivots.select("key", "pivot", "subs"), ["key", "pivot"])
    known = known.withColumn("sub", _share("id", F.col("subs"), "sub")).select("key", "pivot", "sub", "id", "vec")
    return met_in_blocks(left, known, ["key", "pivot", "sub"], k, block_rows, not_itself)


def met_in_blocks(
    asked: DataFrame, known: DataFrame, place: list[str], k: int, block_rows: int, not_itself: bool = True
) -> DataFrame:
    """The best ``k`` rows of ``known`` per row of ``asked`` and place; both hold ``place``, id and vec.

    ``place`` starts with ``key``. Rows asked are cut into turns of bounded size, and the known
    rows of a place are copied once per turn; places that nobody asks for are not moved.
    """
    turns = asked.groupBy(*place).agg(_parts(F.count("*"), block_rows).alias("turns"))
    left = asked.join(turns, place).select(*place, _share("id", F.col("turns"), "turn").alias("turn"), "id", "vec", F.lit(True).alias("is_target"))
    right = known.join(turns, place).select(*place, _every("turns").alias("turn"), "id", "vec", F.lit(False).alias("is_target"))
    return left.unionByName(right).groupBy(*place, "turn").applyInArrow(_score_block(k, not_itself), _SCORED)


def scored_share(entries: DataFrame, k: int, block_rows: int = 4096, not_itself: bool = True) -> tuple[int, int]:
    """(pairs scored, all pairs) of a search, from block sizes."""
    placed, pivots = placed_entries(entries, block_rows)
    pivots = stored(pivots, "pivots")
    first = stored(_own_block(placed, pivots, k, block_rows, not_itself), "first-neighbours")
    left = reachable(placed, pivots, first, k, block_rows)
    subs = pivots.select("key", "pivot", "subs")
    known = (
        placed.where(~F.col("is_target")).join(subs, ["key", "pivot"])
        .groupBy("key", "pivot", _share("id", F.col("subs"), "sub").alias("sub")).agg(F.count("*").alias("n"))
    )
    own = placed.where("is_target").join(subs, ["key", "pivot"]).select("key", "pivot", _share("id", F.col("subs"), "sub").alias("sub"))
    met = own.unionByName(left.select("key", "pivot", "sub")).join(known, ["key", "pivot", "sub"])
    groups = entries.groupBy("key").agg((F.count_if("is_target") * F.count_if(~F.col("is_target"))).alias("pairs"))
    return int(met.agg(F.sum("n")).first()[0] or 0), int(groups.agg(F.sum("pairs")).first()[0] or 0)
