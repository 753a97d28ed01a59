"""Training order on disk: a keyed permutation of all sequences, written as fixed-stride shards.

Sequences are numbered without gaps; a Feistel network on the next power of four, walked until
it lands inside the range, turns a number into a global slot. Slot ranges are shards: a shard
file holds records of equal size in slot order, so record k of shard s is slot s * rows + k,
and a reader resumes at any slot by seeking.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.tokens import tokenizer
from innsight.llm.work import mix, slices, stored

_U = np.uint64
#: Bytes of rows that a task packs together by shard.
_HELD = 16_000_000


def feistel(numbers: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A permutation of 0 .. size - 1, keyed; the same on every machine and retry.

    Halves of b bits each, with 4**b >= size; values beyond the range go through again until
    they fall inside (cycle-walking), which keeps it a bijection.
    """
    half = 1
    while 1 << (2 * half) < size:
        half += 1
    low = _U((1 << half) - 1)
    keys = [mix(np.array([(key + 0x9E3779B97F4A7C15 * (r + 1)) % 2**64], _U))[0] for r in range(rounds)]
    out = numbers.astype(_U)
    open_ = np.ones(len(out), bool)
    while open_.any():
        x = out[open_]
        left, right = x >> _U(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[open_] = left << _U(half) | right
        open_ &= out >= _U(size)
    return out.astype(np.int64)


def sequences(
    docs: DataFrame, vocabulary: str, stride: int, pad_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, ids): whole texts in windows of ``stride`` ids, the last one padded.

    ``ids`` are little-endian 16-bit numbers, ``2 * stride`` bytes. Null and empty texts have no
    sequence.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_column
        pad = np.array([pad_id], "<u2").tobytes() * stride
        for batch in slices(batches, "text", 2_000_000):
            ids, starts, lengths, records = [], [], [], []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                whole = found.tobytes()
                for at in range(0, len(whole), 2 * stride):
                    piece = whole[at : at + 2 * stride]
                    ids.append(doc_id)
                    starts.append(at // 2)
                    lengths.append(len(piece) // 2)
                    records.append(piece + pad[len(piece) :])
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()),
                 pa.array(records, pa.binary())],
                names=["doc_id", "start", "length", "ids"],
            )

    return base.mapInArrow(run, "doc_id long, start long, length int, ids binary")


def with_slots(table: DataFrame, key: int, shard_rows: int) -> DataFrame:
    """All columns with ``slot`` (a permutation of 0 .. rows - 1), ``shard`` and ``record``.

    ``table`` is read straight from Parquet files. A row's number is its place in its file plus
    the rows of the files before, so numbering shuffles nothing and is the same on a retry. One
    count per file reaches the driver and goes out again.
    """
    names = table.columns
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy("_file").agg(F.count("*").alias("n")).orderBy("_file").collect()
    total, before = 0, []
    for r in counts:
        before.append((r["_file"], total))
        total += r["n"]

    @F.pandas_udf("long")
    def slot(number):
        import pandas as pd

        return pd.Series(feistel(number.to_numpy(), total, key))

    files = table.sparkSession.createDataFrame(before, "_file string, _before long")
    placed = rows.join(F.broadcast(files), "_file").withColumn("slot", slot(F.col("_row") + F.col("_before")))
    return placed.select(
        *names, "slot",
        F.expr(f"cast(slot div {shard_rows}L as int)").alias("shard"),
        F.expr(f"slot % {shard_rows}L").alias("record"),
    )


def packed(rows: DataFrame) -> DataFrame:
    """(shard, rows): what a task holds of a shard as one compressed piece of columns.

    Records of many sequences compress further than each of them alone, and fewer bytes are
    shuffled. A task holds ``_HELD`` bytes of rows at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)

        def pieces() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            order = pc.sort_indices(table["shard"])
            shards = table["shard"].to_numpy()[order.to_numpy()]
            starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
            blobs = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(shards)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table.take(order[start:end]))
                plain = sink.getvalue()
                blobs.append(plain.size.to_bytes(8, "little") + codec.compress(plain, asbytes=True))
            return pa.record_batch([pa.array(shards[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "rows"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= _HELD:
                yield pieces()
                size = 0
        if held:
            yield pieces()

    return rows.mapInArrow(run, "shard int, rows binary")


def unpacked(pieces: list[bytes]) -> pa.Table:
    """The rows of some pieces of one shard, in slot order."""
    tables = []
    for piece in pieces:
        plain = pa.decompress(memoryview(piece)[8:], int.from_bytes(piece[:8], "little"), "zstd")
        tables.append(pa.ipc.open_stream(plain).read_all())
    table = pa.concat_tables(tables)
    return table.take(pc.sort_indices(table["slot"]))


def write_shards(rows: DataFrame, path: str) -> DataFrame:
    """Write ``shard-NNNNNNNN.bin`` files below ``path``, and return what was written.

    Returned are the rows without their ids, with ``ids_crc32`` of the record. A task holds one
    whole shard at a time, writes its records in slot order under a name of its own attempt and
    renames the finished file, so a retried or doubled task leaves the same shard. Writing goes
    through Arrow's file systems, which the folder's scheme selects.
    """
    folder = path.rstrip("/")
    names = [c for c in rows.columns if c != "ids"]

    def write(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        store.create_dir(base, recursive=True)
        attempt, shard = uuid.uuid4().hex, key[0].as_py()
        table = unpacked(pieces["rows"].to_pylist())
        crcs = []
        with store.open_output_stream(f"{base}/_{attempt}-{shard}") as out:
            for record in table["ids"].to_pylist():
                out.write(record)
                crcs.append(zlib.crc32(record))
        store.move(f"{base}/_{attempt}-{shard}", f"{base}/shard-{shard:08d}.bin")
        return table.select(names).append_column("ids_crc32", pa.array(crcs, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    dealt = packed(rows).groupBy("shard").applyInArrow(write, f"{schema}, ids_crc32 long")
    return stored(dealt, "training-index", "zstd")


def read_records(folder: str, slot: int, count: int, shard_rows: int, stride: int) -> list[np.ndarray]:
    """``count`` sequences from a global slot on, read by seeking; shorter at the end."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    out: list[np.ndarray] = []
    while len(out) < count:
        shard, record = divmod(slot + len(out), shard_rows)
        name = f"{base}/shard-{shard:08d}.bin"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            break
        with store.open_input_file(name) as source:
            source.seek(2 * stride * record)
            data = source.read(2 * stride * min(count - len(out), shard_rows - record))
        if not data:
            break
        out.extend(np.frombuffer(data, "<u2").reshape(-1, stride))
    return out


def materialise(
    docs: DataFrame, folder: str, vocabulary: str, stride: int = 256, shard_rows: int = 8192,
    key: int = 20240229, pad_id: int = 0,
) -> DataFrame:
    """Sequences of ``docs`` in training order below ``folder``; returns the index of all of them.

    Rows with a null id are sequences like others. Repeated rows and ties give sequences of
    their own. An empty table writes nothing and gives an empty index. Columns other than
    ``doc_id`` and ``text`` are not read.
    """
    # pages of many sequences compress further than each of them alone
    table = stored(sequences(docs, vocabulary, stride, pad_id), "sequences", "zstd", 6)
    return write_shards(with_slots(table, key, shard_rows), folder)
