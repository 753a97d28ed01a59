"""Token ids of the word BPE vocabulary: distinct words are looked up once per batch of texts."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Lower-cased words that ``_SPLIT`` cuts into letters and the marks behind them, if there are any.
_PLAIN = r"^(?P<stem>[a-z]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
_WORDS, _PARTS, _CHUNK = 600_000, 400_000, 256
_ASCII = "".join(map(chr, range(33, 127)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _listed(words: pa.Array) -> list[str]:
    """As ``to_pylist``, which is slower."""
    return words.to_numpy(zero_copy_only=False).tolist()


class _Known:
    """Strings met before and the ids of each, column-wise.

    They are found by hash and then compared, so strings that share a hash cost time only. New
    ones are merged into the sorted hashes; nothing is built again for a lookup.
    """

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint16)
        self.hashes, self.order = np.empty(0, np.int64), np.empty(0, np.int32)

    def __len__(self) -> int:
        return len(self.words)

    def places(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Where each of the words stands, -1 for those not known."""
        if not len(self):
            return np.full(len(words), -1, np.int64)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        at = np.where(self.hashes[spot] == hashes, self.order[spot], -1).astype(np.int64)
        hit = np.flatnonzero(at >= 0)
        same = pc.equal(self.words.take(pa.array(at[hit])), words.take(pa.array(hit)))
        at[hit[~same.to_numpy(zero_copy_only=False)]] = -1
        return at

    def add(self, words: pa.Array, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        rank = np.argsort(hashes)
        spot = np.searchsorted(self.hashes, hashes[rank])
        self.order = np.insert(self.order, spot, (len(self) + rank).astype(np.int32))
        self.hashes = np.insert(self.hashes, spot, hashes[rank])
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes]
        self.sizes = np.r_[self.sizes, sizes.astype(np.int32)]
        self.flat = np.r_[self.flat, flat]
        self.words = pa.concat_arrays([self.words, words])

    def keep(self, at: np.ndarray) -> None:
        """Forget all but those at ``at``, which then stand in that order."""
        words, flat, sizes, hashes = self.words.take(pa.array(at)), self.ids(at), self.sizes[at], np.empty(len(self), np.int64)
        hashes[self.order] = self.hashes
        self.__init__()
        self.add(words, hashes[at], flat, sizes)

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of those at ``at``, one after another."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        shift = np.repeat(self.starts[at] - (ends - sizes), sizes)
        shift += np.arange(len(shift))
        return self.flat[shift]


class WordTokenizer:
    """Ids as little-endian 16-bit numbers, equal to encoding the whole text at once.

    The vocabulary drops white space and never joins across it, so a text's ids are its words'
    ids in order. A batch is split, looked up and put together column-wise. Words that are new are
    normalised by the tokenizer and cut by its own pattern (column-wise, if they are ASCII letters
    with marks behind), and only parts that are new as well are encoded, many at a time: a part's
    last id is one that ends a word. Texts with control strings of the vocabulary are encoded
    whole. Beyond the bounds of known words and parts those that the batch at hand does not use
    are forgotten.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids need 16 bits")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.lowers = self.tokenizer.normalizer.normalize_str(_ASCII) == _ASCII.lower()
        self.parts, self.words = _Known(), _Known()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learnt(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, and how many each has."""
        out: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        chunks = [parts[i : i + _CHUNK] for i in range(0, len(parts), _CHUNK)]
        found = self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)
        for chunk, encoding in zip(chunks, found, strict=True):
            ids = np.array(encoding.ids, "<u2")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(chunk) and "".join(chunk).isprintable():
                out.append(ids[: stops[-1]])
                sizes.append(np.diff(stops, prepend=0))
            else:
                alone = [np.frombuffer(self._whole(part), "<u2") for part in chunk]
                out.extend(alone)
                sizes.append(np.array(list(map(len, alone))))
        return np.concatenate(out), np.concatenate(sizes)

    def _normalised(self, words: list[str]) -> list[str]:
        if not words:
            return []
        joined = " ".join(words)
        if self.lowers and joined.isascii():
            return joined.lower().split(" ")
        found = self.tokenizer.normalizer.normalize_str(joined).split(" ")
        if len(found) != len(words):
            found = [self.tokenizer.normalizer.normalize_str(w) for w in words]
        return found

    def _cut(self, words: list[str]) -> list[list[str]]:
        """The parts of each word; words that do not print are one, which is encoded whole."""
        ascii_ = [w for w in words if w.isascii() and w.isprintable()]
        other = [w for w in words if not w.isascii() and w.isprintable()]
        low = self._normalised(ascii_) + self._normalised(other)
        found = {w: _SPLIT.findall(n) for w, n in zip(ascii_ + other, low, strict=True)}
        return [found.get(w, [w]) for w in words]

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct ``words``, one after another, and how many each has."""
        plain = pc.extract_regex(pc.ascii_lower(words), _PLAIN)
        is_plain = plain.is_valid().to_numpy(zero_copy_only=False) & self.lowers
        at = np.flatnonzero(is_plain)
        stem, tail = (x.take(pa.array(at)) for x in plain.flatten())
        marked = np.flatnonzero(pc.not_equal(tail, "").to_numpy(zero_copy_only=False))
        rest = np.flatnonzero(~is_plain)
        cut = self._cut(_listed(words.take(pa.array(rest))))
        parts = pa.concat_arrays([stem, tail.take(pa.array(marked)), pa.array([p for c in cut for p in c], pa.string())])
        owner = np.concatenate([at, at[marked], np.repeat(rest, list(map(len, cut)))]).astype(np.int64)
        order = np.argsort(owner, kind="stable")  # a word's parts stay in their order
        coded = parts.dictionary_encode()
        places = self._placed(self.parts, coded.dictionary, _PARTS, lambda new: self._learnt(_listed(new)))
        places = places[coded.indices.to_numpy()[order]]
        sizes = np.bincount(owner[order], self.parts.sizes[places], len(words)).astype(np.int64)
        return self.parts.ids(places), sizes

    def _placed(self, known: _Known, words: pa.Array, most: int, learnt) -> np.ndarray:
        """Where the distinct ``words`` stand among the known ones, once those not known are added."""
        hashes = np.fromiter(map(hash, _listed(words)), np.int64, len(words))
        at = known.places(words, hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(known) + len(new) > most:
                hit = np.flatnonzero(at >= 0)
                known.keep(at[hit])
                at[hit] = np.arange(len(hit))
            at[new] = len(known) + np.arange(len(new))
            fresh = words.take(pa.array(new))
            known.add(fresh, hashes[new], *learnt(fresh))
        return at

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null counts as empty."""
        texts = pc.fill_null(texts, "")
        control = pc.match_substring(texts, "<|")
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(control, "", texts), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        at = self._placed(self.words, coded.dictionary, _WORDS, self._encoded)[coded.indices.to_numpy()]
        ends = np.cumsum(self.words.sizes[at], dtype=np.int64)
        ids = self.words.ids(at)
        offsets = lists.offsets.to_numpy()
        cuts = np.r_[0, ends][offsets - offsets[0]]
        found = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in np.flatnonzero(control.to_numpy(zero_copy_only=False)).tolist():
            found[i] = np.frombuffer(self._whole(texts[i].as_py()), "<u2")
        return found

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process; tasks that follow find its words known."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
