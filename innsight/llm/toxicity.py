"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams and of itself; a
text's vector is the mean over its words; a softmax over two classes scores it. Embeddings and
softmax are trained together, in numpy, on a bounded sample of labelled texts. Misspelt words
share n-grams with the words they come from, so they get similar vectors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.work import slices

_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_CACHE, _TOGETHER, _BLOCK = 300_000, 4_000, 1_000_000


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, and the model's shape."""

    sample_rows: int = 3000  # labelled texts of each class at most
    sample_bytes: int = 16_000_000  # and their bytes, of each class
    buckets: int = 1 << 17
    dims: int = 8
    shortest: int = 3
    longest: int = 5
    features: int = 512  # buckets with a vector
    least_texts: int = 4  # texts of the sample a bucket has to occur in
    epochs: int = 400  # chosen on folds of the learnable rows
    rate: float = 0.01
    decay: float = 1e-3


@dataclass(frozen=True)
class Model:
    """Per bucket the embedding, and the softmax; ``weights`` is what scoring needs of both."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    settings: Settings

    @property
    def weights(self) -> np.ndarray:
        """Each bucket's share in the log odds of the second class; the model is linear in them."""
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)

    @property
    def empty(self) -> bool:
        """Whether the sample had nothing to learn from, so that every score is one half."""
        return not self.embeddings.any()

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the marks around them; words of marks alone stay as they are."""
    return (text or "").lower().split()


def word_buckets(word: str, s: Settings) -> list[int]:
    """Hashed n-grams of the word between < and >, and the word itself."""
    word = _EDGES.sub("", word) or word
    marked = f"<{word}>"
    grams = [marked]
    for n in range(s.shortest, s.longest + 1):
        grams.extend(marked[i : i + n] for i in range(len(marked) - n + 1))
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % s.buckets for g in grams]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def buckets_of(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, place of the word) for many words at once, equal to ``word_buckets`` of each.

    A window over characters grows by one character at a time; its checksum goes on from there.
    """
    marked = [f"<{_EDGES.sub('', w) or w}>".encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
    width = np.diff(np.r_[at, len(data)])
    owner = np.repeat(np.arange(len(words)), [len(m) for m in marked])[at]
    buckets = [np.array([zlib.crc32(m) % s.buckets for m in marked], np.int64)]
    owners = [np.arange(len(words))]
    first, crc = np.arange(len(at)), np.full(len(at), 0xFFFFFFFF, np.uint32)
    for n in range(1, s.longest + 1):
        inside = first + n - 1 < len(at)
        first, crc = first[inside], crc[inside]
        inside = owner[first + n - 1] == owner[first]
        first, crc = first[inside], crc[inside]
        added = first + n - 1
        for k in range(width[added].max(initial=0)):
            longer = np.flatnonzero(width[added] > k)
            old = crc[longer]
            crc[longer] = _CRC[(old ^ data[at[added[longer]] + k]) & 0xFF] ^ old >> 8
        if n >= s.shortest:
            buckets.append((crc ^ 0xFFFFFFFF).astype(np.int64) % s.buckets)
            owners.append(owner[first])
    return np.concatenate(buckets), np.concatenate(owners)


def _counted(texts: list[str], s: Settings) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Per text the numbers and counts of its words; the buckets of all words in a row, and their ends.

    A text's n-grams are not kept: they are many times its words.
    """
    numbers: dict[str, int] = {}
    rows = []
    for text in texts:
        counts = Counter(words_of(text))
        found = np.fromiter((numbers.setdefault(w, len(numbers)) for w in counts), np.int32, len(counts))
        rows.append((found, np.fromiter(counts.values(), np.int32, len(counts))))
    words, parts, lengths = list(numbers), [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    numbers.clear()
    for start in range(0, len(words), _TOGETHER):
        found, owner = buckets_of(words[start : start + _TOGETHER], s)
        parts.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
        lengths.append(np.bincount(owner))
    return rows, np.concatenate(parts), np.cumsum(np.concatenate(lengths))


def _grams(words: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the numbered words, one word after the other, and how many each has."""
    lengths = ends[words + 1] - ends[words]
    shift = ends[words] - (np.cumsum(lengths) - lengths)
    return buckets[np.repeat(shift, lengths) + np.arange(lengths.sum())], lengths


def _gram_counts(
    texts: list[str], at: np.ndarray, s: Settings
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts at ``at``: the place, the counts of its words, their buckets, how many each word has.

    Some million characters are counted at once, so what is held does not grow with the texts.
    """
    sizes = np.cumsum([0, *(len(texts[i]) for i in at)])
    start = 0
    while start < len(at):
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + _BLOCK, "right")) - 1)
        rows, buckets, ends = _counted([texts[i] for i in at[start:end]], s)
        for i, (words, counts) in zip(at[start:end].tolist(), rows, strict=True):
            yield i, counts, *_grams(words, buckets, ends)
        start = end


def train(texts: list[str], classes: np.ndarray, settings: Settings = Settings(), seed: int = 7) -> Model:
    """Fit embeddings and softmax jointly: full-batch Adam on the log loss of the sample.

    Only the ``features`` buckets whose presence differs most between the classes, by the
    z-score of two proportions, get a vector; all others weigh nothing, in training and in
    scoring alike, so n-grams of chance words cannot be learnt by heart.
    """
    s = settings
    rng = np.random.default_rng(seed)
    softmax, bias = rng.normal(0, 0.5, (s.dims, 2)), np.zeros(2)
    full = np.zeros((s.buckets, s.dims))
    use = np.array([i for i, text in enumerate(texts) if (text or "").strip()], dtype=np.int64)
    if not len(use) or len(np.unique(classes[use])) < 2:
        return Model(full, softmax * 0, bias, s)
    present = np.zeros((2, s.buckets))
    for i, _, grams, _ in _gram_counts(texts, use, s):
        present[classes[i], np.unique(grams)] += 1
    n = np.bincount(classes[use], minlength=2)
    rates, pooled = present / n[:, None], present.sum(0) / n.sum()
    z = np.abs(rates[1] - rates[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n).sum() + 1e-9)
    z[present.sum(0) < s.least_texts] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[: s.features])
    chosen = chosen[z[chosen] > 0]
    if not len(chosen):
        return Model(full, softmax * 0, bias, s)
    column = np.full(s.buckets, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(use), len(chosen)), np.float32)
    for row, (_, counts, grams, lengths) in enumerate(_gram_counts(texts, use, s)):
        at = column[grams]
        shares = np.repeat(counts / counts.sum() / lengths, lengths)
        x[row] = np.bincount(at[at >= 0], shares[at >= 0], len(chosen))
    scale = np.sqrt((x**2).mean(0)) + 1e-9
    x /= scale.astype(np.float32)
    x = x.astype(np.float64)

    y = np.eye(2)[classes[use]]
    table = rng.normal(0, 0.01, (len(chosen), s.dims))
    state = [np.zeros_like(v) for v in (table, softmax, bias) for _ in (0, 1)]
    for step in range(1, s.epochs + 1):
        hidden = x @ table
        logits = hidden @ softmax + bias
        logits -= logits.max(1, keepdims=True)
        shares = np.exp(logits)
        shares /= shares.sum(1, keepdims=True)
        error = (shares - y) / len(use)
        gradients = (x.T @ (error @ softmax.T) + s.decay * table, hidden.T @ error, error.sum(0))
        for k, (value, gradient) in enumerate(zip((table, softmax, bias), gradients, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            value -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    full[chosen] = table / scale[:, None]
    return Model(full, softmax, bias, s)


def training_sample(
    docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str
) -> tuple[list[str], np.ndarray]:
    """Up to ``sample_rows`` whole texts and ``sample_bytes`` of each class, by hash of the id.

    Ids and sizes are ranked first; only the chosen texts reach the driver. A text that does not
    fit into what is left of the bytes is passed over, and the next ones are still tried.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).cast("int").alias("_class")
    )
    sized = docs.select(F.col(id_col).alias("_id"), F.octet_length(F.col(text_col).cast("string")).alias("_size"))
    fitting = F.col("_size").between(1, settings.sample_bytes)
    ranked = sized.where(fitting).join(known, "_id").withColumn("_order", F.xxhash64("_id"))
    chosen = []
    for value in (0, 1):
        total = 0
        for row in ranked.where(F.col("_class") == value).orderBy("_order", "_id").limit(settings.sample_rows).collect():
            if total + row["_size"] > settings.sample_bytes:
                continue
            total += row["_size"]
            chosen.append((row["_id"], value))
    if not chosen:
        return [], np.empty(0, np.int64)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    frame = spark.createDataFrame(sorted(set(chosen)), f"_id {kind}, _class int")
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .join(F.broadcast(frame), "_id")  # at most 2 * sample_rows ids
        .groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_class").alias("_class"))
        .collect()
    )
    rows.sort(key=lambda r: str(r["_id"]))
    return [r["_text"] for r in rows], np.array([r["_class"] for r in rows], dtype=np.int64)


def learnt(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic", learnable: Column | None = None,
) -> Model:
    """A model from the labelled rows that ``learnable`` admits (all by default)."""
    if learnable is not None:
        labels = labels.where(learnable)
    return train(*training_sample(docs, labels, settings, id_col, text_col, label_col), settings)


def word_weights(words: list[str], weights: np.ndarray, s: Settings) -> np.ndarray:
    """What each word's n-grams weigh on average; some thousand words are cut into n-grams at once."""
    out = [np.empty(0)]
    for start in range(0, len(words), _TOGETHER):
        buckets, owner = buckets_of(words[start : start + _TOGETHER], s)
        out.append(np.bincount(owner, weights[buckets]) / np.bincount(owner))
    return np.concatenate(out)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of the second class, from 0 to 1.

    A text's log odds are the mean over its words of what each word's n-grams weigh, plus the
    bias; so a whole text of any length is scored in one pass with a cache of words. Null and
    empty texts get the bias alone. Every row is scored by its text only. An empty table gives
    an empty result; an existing column of the result's name is replaced.
    """
    weights, offset, s = model.weights, model.offset, model.settings
    docs = docs.drop(*[c for c in docs.columns if c == name])
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in slices(batches, text_col, 500_000):
            out = []
            split = [words_of(t) for t in batch.column(text_col).to_pylist()]
            new = set().union(*split).difference(cache)
            if len(cache) + len(new) > _CACHE:
                cache.clear()
                new = set().union(*split)
            if new:
                fresh = list(new)
                cache.update(zip(fresh, word_weights(fresh, weights, s).tolist(), strict=True))
            for words in split:
                odds = offset + (sum(map(cache.__getitem__, words)) / len(words) if words else 0.0)
                out.append(1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500))))
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array(out, pa.float64())], names=[*names, name]
            )

    return docs.mapInArrow(run, f"{schema}, `{name}` double")
