"""Near-duplicate join on word shingles (exact Jaccard), and the groups it forms.

Documents are cut into size bands; a link only exists within a band or with the next. Inside
the band pair of a tile, linked sets differ in at most H shingles, so of H + 1 hashed parts at
least one is the same in both: documents meet under (band, part, content of the part). Met
documents are tested by bit counts of hashed bitmaps, which bound the overlap from above, and
then by intersecting the sorted shingle arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.work import components, mix, slices, stored, within

BITMAP_BITS = 2048
#: Up to this size empty parts are followed by further partitions, so that no link can be missed.
SMALL_SET = 128
_LEVELS = 8
_SEEN = 500_000
_BLOCK = 2000
_U = np.uint64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, lower-cased in A-Z."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, _U)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=_U)
    size = min(words, len(hashed))
    rows = len(hashed) - size + 1
    out = np.full(rows, size, _U)
    for k in range(size):
        out = mix(out + hashed[k : k + rows])
    return np.unique(out)


def bands(percent: int, largest: int) -> list[tuple[int, int]]:
    """(largest size, number of parts) of each band up to the one that holds ``largest``."""
    out, low = [], 1
    while low <= largest:
        following = low * 100 // percent + 1
        high = following - 1
        differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        out.append((high, differ + 1))
        low = following
    return out


def _part_keys(values: np.ndarray, band: int, parts: int, small: bool) -> np.ndarray:
    """Keys of one tile: one per part that holds shingles; small sets settle empty parts too."""
    keys = []
    for level in range(_LEVELS if small else 1):
        scrambled = mix(values + _U(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64))
        part = (scrambled >> _U(32)) % _U(parts)
        order = np.argsort(part, kind="stable")
        part, content = part[order], mix(scrambled[order])
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.add.reduceat(content, starts)
        tag = _U(band << 40 | level << 32)
        keys.append(mix(mix(sums) + mix(part[starts] + tag)))
        if len(starts) == parts:
            break
        if small and level == _LEVELS - 1:
            empty = np.setdiff1d(np.arange(parts, dtype=_U), part[starts])
            keys.append(mix(_U(1) + mix(empty + tag)))
    return np.concatenate(keys)


def tile_keys(values: np.ndarray, edges: list[tuple[int, int]], highs: np.ndarray) -> np.ndarray:
    """Keys a set meets others under: its own band's tile and that of the band below."""
    band = int(np.searchsorted(highs, len(values)))
    return np.concatenate(
        [_part_keys(values, k, edges[k][1], edges[k][0] <= SMALL_SET) for k in (band, band - 1) if k >= 0]
    )


def bitmap(values: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(mix(values ^ _U(0xD6E8FEB86659FD93)) % _U(bits)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _digest(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) & 0x7FFFFFFFFFFFFFFF


def shingle_counts(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest) of every row; the digest names the set, null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_digest(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "digest"],
            )

    return _sets(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, digest long")


def _keyed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, doc_id) of every different set; a task emits a set it has seen before only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bands(percent, 1 << 16)
        highs = np.array([h for h, _ in edges])
        seen: set[int] = set()
        for batch in slices(batches, "text", 1_000_000):
            keys, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                values = shingle_hashes(text, words) if doc_id is not None else ()
                if not len(values):
                    continue
                digest = _digest(values)
                if digest in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(digest)
                if len(values) > highs[-1]:
                    edges = bands(percent, len(values))
                    highs = np.array([h for h, _ in edges])
                keys.append(tile_keys(values, edges, highs))
                ids.append(np.full(len(keys[-1]), doc_id, np.int64))
            if keys:
                yield pa.record_batch(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))],
                    names=["key", "doc_id"],
                )

    return docs.mapInArrow(run, "key long, doc_id long")


def _meetings(keyed: DataFrame) -> DataFrame:
    """(key, a, b): each document b under a key with the key's smallest document a.

    Rows arrive sorted, so a key of any size streams by and only its smallest id is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_pivot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = (batch.column(c).to_numpy() for c in ("key", "doc_id"))
            fresh = np.r_[True, keys[1:] != keys[:-1]]
            starts = np.flatnonzero(fresh)
            pivots = ids[starts]
            if last_key is not None and keys[0] == last_key:
                pivots = pivots.copy()
                pivots[0] = last_pivot
            pivot = pivots[np.cumsum(fresh) - 1]
            last_key, last_pivot = keys[-1], pivots[-1]
            hit = pivot != ids
            if hit.any():
                yield pa.record_batch(
                    [pa.array(keys[hit]), pa.array(pivot[hit]), pa.array(ids[hit])], names=["key", "a", "b"]
                )

    dealt = keyed.repartition("key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(run, "key long, a long, b long")


def _payload(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest, n, bits, shingles) for the documents that met another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            sets = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            keep = np.array([len(s) > 0 for s in sets], bool)
            sets = [s for s in sets if len(s)]
            yield pa.record_batch(
                [batch.column("doc_id").filter(pa.array(keep)), pa.array([_digest(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([bitmap(s) for s in sets], pa.list_(pa.int64())),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n", "bits", "shingles"],
            )

    return docs.mapInArrow(run, "doc_id long, digest long, n int, bits array<long>, shingles array<long>")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those of different sets whose sizes and bitmaps allow a link."""
    small = sets.select("doc_id", "digest", "n", "bits")
    differ = F.aggregate(
        F.zip_with("x_bits", "y_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")),
        F.lit(0), lambda total, n: total + n,
    )
    # 100 i >= p u with u = x + y - i, and i is at most (x + y - differing bits) / 2
    return (
        pairs.join(small.toDF("a", "x_digest", "x_n", "x_bits"), "a")
        .join(small.toDF("b", "y_digest", "y_n", "y_bits"), "b")
        .where("x_digest != y_digest")
        .where(100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
        .where((100 + percent) * (F.col("x_n") + F.col("y_n") - differ) >= 2 * percent * (F.col("x_n") + F.col("y_n")))
        .select("a", "b")
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs of documents (a, b) the digests (a, b) of those that link.

    Two sets are compared once, however many documents hold them. Pairs are stored first, so
    only the shingles of sets that stand in one are shuffled.
    """
    names = sets.select("doc_id", "digest").distinct()
    named = pairs.join(names.toDF("a", "x_digest"), "a").join(names.toDF("b", "y_digest"), "b").where("x_digest != y_digest")
    single = named.groupBy("x_digest", "y_digest").agg(F.min(F.struct("a", "b")).alias("p"))
    single = stored(single.select("p.a", "p.b", "x_digest", "y_digest"), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = []
            for name in ("x", "y"):
                column = batch.column(name)
                arrays.append((column.values.to_numpy(), column.offsets.to_numpy()))
            (xs, xo), (ys, yo) = arrays
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = xs[xo[i] : xo[i + 1]].view(_U), ys[yo[i] : yo[i + 1]].view(_U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.record_batch(
                [batch.column(c).filter(pa.array(keep)) for c in ("x_digest", "y_digest")], names=["a", "b"]
            )

    left = within(sets, "doc_id", single, "a").select(F.col("doc_id").alias("a"), F.col("digest").alias("x_digest"), F.col("shingles").alias("x"))
    right = within(sets, "doc_id", single, "b").select(F.col("doc_id").alias("b"), F.col("digest").alias("y_digest"), F.col("shingles").alias("y"))
    return (
        single.join(right, ["b", "y_digest"]).join(left, ["a", "x_digest"]).select("x_digest", "y_digest", "x", "y")
        .mapInArrow(run, "a long, b long")
    )


def _crossing(members: DataFrame, bitmaps: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b): pairs under a key whose labels differ and whose bitmaps allow a link.

    With ``nearest`` a member gives only the partner whose bitmap differs least. Members of one
    label are known to be connected and are not paired. A key of many members is dealt out in
    tiles of two blocks, so a task holds about two blocks of bitmaps, however large the key.
    """
    sized = members.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")
    )
    sized = sized.where("lo != hi").select("key", F.expr(f"cast(ceil(size / {_BLOCK}) as int)").alias("blocks"))
    rows = members.join(sized, "key").join(bitmaps, "doc_id").withColumn("block", F.pmod(F.hash("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "label",
        "doc_id", "n", "bits",
    )

    def tile(block, label, ids, n, bits, lo, hi):
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        best: dict[int, tuple[int, int]] = {}
        for i in left:
            among = right[right > i] if lo == hi else right
            among = among[label[among] != label[i]]
            among = among[100 * np.minimum(n[among], n[i]) >= percent * np.maximum(n[among], n[i])]
            if not len(among):
                continue
            both = n[among] + n[i]
            differ = np.bitwise_count(bits[among] ^ bits[i]).sum(1, dtype=np.int64)
            fits = (100 + percent) * (both - differ) >= 2 * percent * both
            among, differ = among[fits], differ[fits]
            if not nearest:
                yield from ((int(ids[i]), int(ids[j])) for j in among)
                continue
            for j, d in zip(among.tolist(), differ.tolist(), strict=True):
                for x, y in ((int(i), j), (j, int(i))):
                    if x not in best or d < best[x][0]:
                        best[x] = (d, y)
        yield from ((int(ids[x]), int(ids[y])) for x, (_, y) in best.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found):
            pairs = np.sort(np.array(found, np.int64), axis=1)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def flush(parts):
            columns = [np.concatenate(c) for c in zip(*(p[1:] for p in parts), strict=True)]
            found = []
            for pair in tile(*columns, *parts[0][0][1:]):
                found.append(pair)
                if len(found) == 100_000:
                    yield batch_of(found)
                    found = []
            if found:
                yield batch_of(found)

        parts: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi, block, label, ids, n = (batch.column(i).to_numpy() for i in range(7))
            bits = batch.column(7)
            bits = bits.values.to_numpy()[bits.offsets[0].as_py() : bits.offsets[-1].as_py()].view(_U).reshape(len(key), -1)
            fresh = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            edges = [*np.flatnonzero(fresh).tolist(), len(key)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                name = (int(key[start]), int(lo[start]), int(hi[start]))
                if parts and parts[0][0] != name:
                    yield from flush(parts)
                    parts = []
                cut = slice(start, end)
                parts.append((name, block[cut], label[cut], ids[cut], n[cut].astype(np.int64), bits[cut]))
        if parts:
            yield from flush(parts)

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "label", "doc_id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicate_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two rows link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
    ``words``-word shingles (a shorter text is one shingle). The component id is the smallest
    id reachable by links. Equal texts form one class before any comparison; a row is given
    back for each of them. Texts without words (null, empty, blank) link with nothing and keep
    their own id; rows without an id link with nothing and have a null component. Rows that
    repeat an id are documents of their own. Only the two named columns are read, so others
    may have any name. An empty table gives an empty result.

    Sets are compared as 64-bit hashes of shingles. Above ``SMALL_SET`` shingles a link is
    missed only if all parts that agree are empty (under 1e-12 per link by chance); below it
    never.
    """
    spark: SparkSession = docs.sparkSession
    base = _sets(docs, id_col, text_col)
    light = stored(shingle_counts(base, words), "shingle-counts")
    classes = light.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    hits = stored(_meetings(_keyed(base, words, percent)), "meetings")
    met = hits.select(F.col("a").alias("id")).unionByName(hits.select(F.col("b").alias("id"))).distinct()
    sets = stored(_payload(within(base, "doc_id", met, "id"), words), "shingle-sets")

    digests = sets.select("doc_id", "digest").distinct()
    first = hits.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(_linked(_possible(first, sets, percent), sets, percent), "links")
    labels = components(links)

    def labelled() -> DataFrame:
        """(key, doc_id, label): the label of a member's set is its component so far, else the set itself."""
        known = labels.select(F.col("node").alias("digest"), F.col("label").alias("_l"))
        own = digests.join(known, "digest", "left").select("doc_id", F.coalesce("_l", "digest").alias("label"))
        return members.join(own, "doc_id")

    # One meeting per document has joined most. Of what shares a key and is still apart, the nearest
    # partners come next, and then every pair that the bitmaps allow.
    members = hits.select("key", F.col("a").alias("doc_id")).unionByName(hits.select("key", F.col("b").alias("doc_id")))
    members = stored(members.distinct(), "members")
    small = sets.select("doc_id", "n", "bits")
    for nearest in (True, False):
        apart = _crossing(labelled(), small, percent, nearest)
        rest = stored(_linked(apart, sets, percent), "links")
        links = links.unionByName(rest)
        if nearest:
            labels = components(links)
    links = links.join(classes.select(F.col("digest").alias("a"), F.col("rep").alias("ra")), "a")
    links = links.join(classes.select(F.col("digest").alias("b"), F.col("rep").alias("rb")), "b")
    groups = components(links, "ra", "rb")

    named = classes.join(groups, classes.rep == groups.node, "left").select(
        "digest", F.coalesce("label", "rep").alias("component")
    )
    return light.join(named, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
