"""SentencePiece encoding and decoding by a forward pass over a trie of distinct words.

A text is normalised, blanks become the mark ``▁``, and it falls into marked words, across which
no piece reaches. The distinct words of a batch are sorted, so that neighbours share prefixes:
going through them is a depth-first walk over their trie, and the forward states of a shared
prefix are computed once.

The state at a character is the best last piece that ends there. In a unigram model that is the
piece with the largest sum of scores (Viterbi). In a BPE model the scores order merges and do
not add up; there the state is the piece that can follow the state at its start without either
being merged otherwise. Pieces that stay as they are side by side are exactly what merging the
whole word gives, so the walk is the same with a test of neighbours in place of a sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.work import slices

_MARKED = re.compile("▁*[^▁]+|▁+")
_UNIGRAM, _BPE = 1, 2
#: Known words by the characters they hold, and known pairs of neighbours: together under 200 MB a worker.
_CHARACTERS, _PAIRS = 4_000_000, 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary with its kind; encodes sorted words and decodes ids."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        self.bpe = model.trainer_spec.model_type == _BPE
        if not self.bpe and model.trainer_spec.model_type != _UNIGRAM:
            raise ValueError("only unigram and BPE models")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == 1]
        if any("▁" in p.piece.lstrip("▁") for _, p in normal):
            raise ValueError("pieces reach across words")
        self.ids = {p.piece: i for i, p in normal}
        self.scores = {p.piece: p.score for _, p in normal}
        self.endings = {p.piece[k:] for _, p in normal for k in range(len(p.piece))}
        self.unknown_score = min((p.score for _, p in normal), default=0.0) - 10.0
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.out = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type in (1, 4):
                self.out[i] = p.piece.replace("▁", " ").encode()
            elif p.type == 6:
                self.out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.out[i] = " ⁇ ".encode()
        self.names = [p.piece for p in model.pieces]
        #: pieces of a BPE model that merging gives for their own text; no others can occur
        self.reached = {p: i for p, i in self.ids.items() if self.bpe and self.merged(p) == [p]}
        self.stable: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.characters = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _beside(self, before: str, left: int | None, right: int) -> bool:
        """Whether piece ``right`` stays next to ``before``, whose id is ``left`` (none if it is no piece)."""
        known = self.merged(before + self.names[right]) == [before, self.names[right]]
        if left is not None:
            if len(self.stable) > _PAIRS:
                self.stable.clear()
            self.stable[left * len(self.names) + right] = known
        return known

    def _extend_merges(self, word: str, starts: list[int], lasts: list[int | None]) -> None:
        """States of a BPE model from the depth reached to the word's end."""
        reached, stable, endings, size = self.reached, self.stable, self.endings, len(self.names)
        for end in range(len(starts), len(word) + 1):
            start, found, last = end - 1, end - 1, None
            while start >= 0:  # as long as some piece ends like this
                piece = word[start:end]
                i = reached.get(piece)
                if i is not None:
                    left = lasts[start]
                    known = not start or (None if left is None else stable.get(left * size + i))
                    if known is None:
                        known = self._beside(word[starts[start] : start], left, i)
                    if known:
                        found, last = start, i
                        break
                elif start < end - 1 and piece not in endings:
                    break
                start -= 1
            starts.append(found)
            lasts.append(self.ids.get(word[found:end]) if last is None else last)

    def _extend_sums(self, word: str, starts: list[int], totals: list[float]) -> None:
        """States of a unigram model from the depth reached to the word's end."""
        for end in range(len(starts), len(word) + 1):
            best_start, best, start = end - 1, None, end - 1
            while start >= 0:  # as long as some piece ends like this
                piece = word[start:end]
                score = self.scores.get(piece)
                if score is None:
                    if start == end - 1:
                        score = self.unknown_score
                    elif piece not in self.endings:
                        break
                if score is not None and (best is None or totals[start] + score >= best):
                    best, best_start = totals[start] + score, start  # ties: the longer last piece
                start -= 1
            starts.append(best_start)
            totals.append(best or 0.0)

    def _ids(self, piece: str) -> bytes:
        found = self.ids.get(piece)
        if found is None:
            found = [self.bytes[b] for b in piece.encode()] if self.bytes else self.unknown
        return np.array(found, "<i4").tobytes()

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; ``words`` are distinct and sorted."""
        # states by depth: where the last piece starts, and its id or the score of the best way here
        starts: list[int] = [0]
        states: list = [None if self.bpe else 0.0]
        extend = self._extend_merges if self.bpe else self._extend_sums
        known: dict[str, bytes] = {}
        out, previous = [], ""
        for word in words:
            depth, most = 0, min(len(previous), len(word))
            while depth < most and previous[depth] == word[depth]:
                depth += 1
            del starts[depth + 1 :], states[depth + 1 :]
            extend(word, starts, states)
            parts, end = [], len(word)
            while end:
                piece = word[starts[end] : end]
                ids = known.get(piece)
                if ids is None:
                    ids = known[piece] = self._ids(piece)
                parts.append(ids)
                end = starts[end]
            out.append(b"".join(reversed(parts)))
            previous = word
        return out

    def marked(self, text: str) -> list[str]:
        """The marked words of a text; they join to its normalised form."""
        return _MARKED.findall(self.library.normalize(text).replace(" ", "▁"))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; words new to the cache are walked together, in order."""
        split = [self.marked(t) for t in texts]
        met = set().union(*split)
        ordered = sorted(met.difference(self.words))
        characters = sum(map(len, ordered))
        if self.characters + characters > _CHARACTERS:
            self.words = {w: self.words[w] for w in met if w in self.words}
            self.characters = sum(map(len, self.words))
        self.words.update(zip(ordered, self.encode_sorted(ordered), strict=True))
        self.characters += characters
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become blanks, the added first one goes, bytes are put together."""
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_texts(
    docs: DataFrame, model: str, text_col: str = "text", name: str = "ids", decoded: str | None = None
) -> DataFrame:
    """All columns of ``docs`` and the ids of the whole text, equal to the library's own.

    With ``decoded`` a column of that name holds the text read back from the ids, in the same
    pass. Null and empty texts have no ids (an empty array, read back as an empty text). Every
    row is encoded by itself, whole however long it is; ties between pieces are settled as the
    library does, and repeated rows get the same ids. An empty table gives an empty result;
    existing columns of the results' names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c in (name, decoded) and c != text_col])
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    added = [name] if decoded is None else [name, decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in slices(batches, text_col, 1_000_000):
            ids = vocabulary.encode([t or "" for t in batch.column(text_col).to_pylist()])
            offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded is not None:
                new.append(pa.array([vocabulary.decode(i) for i in ids], pa.string()))
            yield pa.record_batch([*(batch.column(c) for c in names), *new], names=[*names, *added])

    kinds = [f"`{name}` array<int>"] + ([] if decoded is None else [f"`{decoded}` string"])
    return docs.mapInArrow(run, ", ".join([schema, *kinds]))


def decode_ids(rows: DataFrame, model: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the decoded text; null ids give a null text, control pieces give nothing."""
    rows = rows.drop(*[c for c in rows.columns if c == name and c != ids_col])

    @F.pandas_udf("string")
    def run(batch):
        import pandas as pd

        vocabulary = pieces(model)
        return pd.Series([None if ids is None else vocabulary.decode(np.asarray(ids)) for ids in batch], dtype=object)

    return rows.withColumn(name, run(F.col(ids_col)))
