"""Encoding of a corpus with a public byte-level BPE vocabulary, by batched numpy merge rounds.

A batch's texts are cut into words by the vocabulary's pattern; words not met before by the worker
lie as byte symbols in one flat array, and each round finds the pair of lowest rank of every word by
binary search over the sorted pair keys and merges it, for all words at once. A round passes over the
whole array, so words of more than ``LONG`` bytes (unbroken runs) are merged apart, with a heap of their
pairs and links between the symbols that are left: a merge touches two neighbours, and the time is
n log n in the length of the run.

Null and empty texts give an empty list; strings of special tokens are ordinary text; other columns
are ignored; repeated rows are encoded again, a row each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.session import spread

_NONE = np.int64(1) << 40
#: Bytes of a word from which on it is merged by heap.
LONG = 512
#: Words a worker remembers; beyond it, it starts again.
MEMORY = 600_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """The GPT-2 word pattern with letters, numbers and spaces as explicit classes.

    The classes come from Unicode's categories, because the module's \\w and \\s differ from them.
    """
    space = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

    def ranges(first: str) -> str:
        out, start, prev = [], None, None
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == first:
                if start is None:
                    start = c
                prev = c
            elif start is not None:
                out.append(f"\\U{start:08x}-\\U{prev:08x}")
                start = None
        return "".join(out)

    letters, numbers = ranges("L"), ranges("N")
    return re.compile(
        rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Vocabulary:
    """Ranks of a .tiktoken file as sorted pair keys."""

    def __init__(self, data: bytes):
        ranks: dict[bytes, int] = {}
        for line in data.splitlines():
            a, _, b = line.partition(b" ")
            if b:
                ranks[base64.b64decode(a)] = int(b)
        self.bytes_to_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left = ranks.get(token[:k])
                if left is not None and (right := ranks.get(token[k:])) is not None:
                    keys.append(left << 20 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.merged.tolist()))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word. The heap holds (rank, place) in one number; an entry counts only if the pair
        that stands there now has this rank, so outdated ones need not be taken out."""
        start = self.bytes_to_id[np.frombuffer(word, np.uint8)]
        rank = self.ranks_of(start[:-1], start[1:])
        at = np.flatnonzero(rank < _NONE)
        heap = ((rank[at] << 32) | at).tolist()
        heapify(heap)
        n, known = len(start), self.pairs.get
        # four bytes a number: a run may be as long as a document
        sym, following, before = (array("i", x.astype(np.int32).tobytes()) for x in (start, np.arange(1, n + 1), np.arange(-1, n - 1)))
        while heap:
            entry = heappop(heap)
            new, i = entry >> 32, entry & 0xFFFFFFFF
            j = following[i]
            if sym[i] < 0 or j >= n or known(sym[i] << 20 | sym[j]) != new:
                continue
            k = following[j]
            sym[i], sym[j], following[i] = new, -1, k
            if k < n:
                before[k] = i
                if (r := known(new << 20 | sym[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := known(sym[h] << 20 | new)) is not None:
                heappush(heap, r << 32 | h)
        out = np.frombuffer(sym, np.int32)
        return out[out >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the length of each word's part."""
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if long:
            sym, size = self.merge([b"" if len(w) > LONG else w for w in words])
            parts, at = [], 0
            ends = np.cumsum(size)
            for k in long:
                parts += [sym[at : ends[k]], self.merge_long(words[k])]
                at, size[k] = int(ends[k]), len(parts[-1])
            return np.concatenate([*parts, sym[at:]]), size
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.bytes_to_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while True:
            same = word[:-1] == word[1:]
            rank = np.where(same, self.ranks_of(sym[:-1], sym[1:]), _NONE) if len(sym) > 1 else np.empty(0, np.int64)
            # words that have no pair left are put aside
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
            if not len(first):
                break
            low = np.minimum.reduceat(np.r_[rank, _NONE], first)
            size = np.diff(np.r_[first, len(sym)])
            low_at = np.repeat(low, size)
            rest = low_at < _NONE
            if not rest.all():
                done_sym.append(sym[~rest])
                done_word.append(word[~rest])
                if not rest.any():
                    break
            hit = np.r_[rank, _NONE] == low_at
            hit &= rest
            at = np.flatnonzero(hit)
            # of overlapping hits (aaa) every second one from the left counts
            if len(at) > 1:
                run = np.r_[True, np.diff(at) != 1]
                start = np.flatnonzero(run)
                nth = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
                at = at[nth % 2 == 0]
            sym = sym.copy()
            sym[at] = low_at[at]
            keep = rest.copy()
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    def __init__(self, data: bytes):
        self.vocab = Vocabulary(data)
        self.split = word_pattern().findall
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        sym, size = self.vocab.merge([w.encode("utf-8", "surrogatepass") for w in words])
        base = len(self.start)
        self.index.update(zip(words, range(base, base + len(words))))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.flat = np.concatenate([self.flat, sym])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and offsets."""
        if len(self.index) > MEMORY:
            self.reset()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                w = self.split(t)
                counts[k] = len(w)
                words += w
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.start[at] - (ends - size), size)
        take += np.arange(total)
        word_ends = np.r_[0, np.cumsum(counts)]
        return self.flat[take], np.r_[0, ends][word_ends]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    return _encoder(path, Path(path).read_bytes)


def _encoder(name: str, read: Callable[[], bytes]) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(read())
    return _encoders[name]


def _slices(texts: list[str | None], most: int = 2_000_000) -> Iterable[tuple[int, int]]:
    a = n = 0
    for k, t in enumerate(texts):
        n += len(t) if t else 0
        if n >= most:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of each document. No shuffle; memory is bounded by a slice of texts.

    The driver reads the vocabulary's file, of a megabyte or so, and broadcasts what is in it."""
    data = Path(vocabulary or default_vocabulary()).read_bytes()
    name, sent = hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc = _encoder(name, lambda: sent.value)
        for b in batches:
            texts = b[1].to_pylist()
            for a, e in _slices(texts):
                flat, offsets = enc.encode(texts[a:e])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b[0].slice(a, e - a), ids], ["doc_id", "ids"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")
