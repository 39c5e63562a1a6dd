"""Evaluation texts leaking into training text, found with suffix arrays of the training words.

Each task makes shards of its documents. Their words, as numbers of the test set's vocabulary, lie in one
array, and the order of its suffixes comes from prefix doubling: round k ranks every place by its first
2^k words, from the ranks of the round before, so that a shard of n words takes n log^2 n steps however
repetitive it is. Every suffix of every test passage is placed in the suffix array by bisection. In the
stretch of suffixes that share its first ``min_words`` words, the neighbours of that place give the
longest verbatim match with each document; how long it is tell the ranks of all rounds, by halving, so
that nothing is extended word by word and no occurrence is paired with every other.

Words outside the test vocabulary end a stretch; only stretches of ``min_words`` words or more enter the
array, as no other can match; this drops nothing and keeps the arrays small. The test set is broadcast;
its size is checked against ``MAX_TEST_WORDS``, and a larger one is searched in parts of that size.

Words are runs of letters and digits, regardless of case; HTML tags, punctuation, white space and
entities don't count. Matches don't run over the end of a document or of a passage. Null and empty
texts, and passages shorter than ``min_words``, match nothing; repeated rows give a row each of the
same report (``p9_found`` is distinct); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, spread

MAX_TEST_WORDS = 2_000_000
#: Words of a shard, about.
SHARD_CHARS = 4_000_000
_find = re.compile(r"[^\W_]+|\x00").findall
_tag = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
SCHEMA = "doc_id bigint, qid bigint, field string, words int, doc_word int, test_word int"


def plain(text: str) -> str:
    """Lower-cased text without tags, ready for ``words``."""
    if "<" in text:
        text = _tag.sub(" ", text)
    if "&" in text:
        text = unescape(text)
    return text.lower().replace("\x00", " ")


def words(text: str) -> list[str]:
    return [w for w in _find(plain(text)) if w != "\x00"]


class TestSet:
    """Suffixes of all passages, at least ``min_words`` long, over the passages' own vocabulary."""

    __test__ = False

    def __init__(self, passages: list[tuple[int, str, str | None]], min_words: int):
        self.vocabulary: dict[str, int] = {"\x00": 0}
        self.min_words = min_words
        ids: list[int] = []
        owner: list[int] = []
        self.names: list[tuple[int, str]] = []
        self.first: list[int] = []
        for qid, field, text in passages:
            ws = words(text) if text else []
            if len(ws) < min_words:
                continue
            self.first.append(len(ids))
            self.names.append((qid, field))
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] + [0]
            owner += [len(self.names) - 1] * (len(ws) + 1)
        self.ids, self.owner = np.array(ids or [0], np.int32), np.array(owner or [0], np.int32)
        self.starts = np.flatnonzero(_runs(self.ids) >= min_words)


def _runs(ids: np.ndarray) -> np.ndarray:
    """For each place, how many words of the vocabulary follow one another from there."""
    bad = np.flatnonzero(ids <= 0)
    nxt = np.searchsorted(bad, np.arange(len(ids)))
    ends = np.r_[bad, len(ids)]
    return ends[nxt] - np.arange(len(ids))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Suffixes:
    """Ranks of all suffixes of an array by their first 1, 2, 4 ... words, up to ``longest`` words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.n = len(ids)
        self.levels = [_dense(ids)]
        while 1 << (len(self.levels) - 1) < longest:
            h, r = 1 << (len(self.levels) - 1), self.levels[-1]
            after = np.zeros(self.n, np.int64)
            after[: self.n - h] = r[h:] + 1
            self.levels.append(_dense(r * (self.n + 1) + after))

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1]

    def heads(self, at: np.ndarray, words: int) -> np.ndarray:
        """A number for the first ``words`` words at each place; equal heads have equal numbers."""
        out, done = np.zeros(len(at), np.int64), 0
        for k in range(len(self.levels) - 1, -1, -1):
            while words - done >= 1 << k:
                out = _dense(out * (self.n + 1) + self.levels[k][at + done])
                done += 1 << k
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common from their first."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + length, b + length
            ok = (x < self.n) & (y < self.n)
            length += np.where(ok & (self.levels[k][np.where(ok, x, 0)] == self.levels[k][np.where(ok, y, 0)]), 1 << k, 0)
        return length


#: (test suffix, document) pairs looked at together.
PAIRS = 1_000_000


def search(test: TestSet, docs: list[tuple[int, str | None]]) -> list[tuple[int, int, str, int, int, int]]:
    """Longest verbatim match of each document with each passage; of several, the one nearest to the document's begin."""
    kept = [(d, plain(t)) for d, t in docs if t]
    if not kept or not len(test.starts):
        return []
    found = _find("\n\x00\n".join(t for _, t in kept) + "\n\x00")
    n = test.min_words
    words_of = np.fromiter(map(test.vocabulary.get, found, repeat(-1)), np.int64, len(found))
    runs = _runs(words_of)
    starts = np.flatnonzero(runs >= n)
    if not len(starts):
        return []
    # the stretches with a start in them, each with the word that ends it
    first = starts[np.r_[True, np.diff(starts) != 1]]
    first = first[np.r_[True, first[1:] >= (first + runs[first])[:-1]]]
    size = runs[first] + 1
    place = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    m = len(test.ids)
    joint = np.r_[test.ids.astype(np.int64), words_of[place]]
    ends = joint <= 0
    joint[ends] = len(test.vocabulary) + np.arange(ends.sum())  # each end is like no other
    longest = int(min(_runs(test.ids).max(), runs[first].max()))
    s = Suffixes(joint, max(longest, n))
    train = np.flatnonzero(~ends[m:] & (runs[place] >= n)) + m
    heads = s.heads(np.r_[train, test.starts], n)
    train_head, test_head = heads[: len(train)], heads[len(train) :]
    hit = np.isin(train_head, test_head)
    train, train_head = train[hit], train_head[hit]
    if not len(train):
        return []
    doc_ends = np.flatnonzero(words_of == 0)
    doc = np.searchsorted(doc_ends, place[train - m])
    # the suffix array, parted by head and document
    order = np.lexsort((place[train - m], s.rank[train], doc, train_head))
    train, train_head, doc = train[order], train_head[order], doc[order]
    new = np.r_[True, (train_head[1:] != train_head[:-1]) | (doc[1:] != doc[:-1])]
    group = np.cumsum(new) - 1
    group_at = np.flatnonzero(new)
    group_head, group_doc = train_head[group_at], doc[group_at]
    key = group * (s.n + 1) + s.rank[train]
    lo, hi = np.searchsorted(group_head, test_head, "left"), np.searchsorted(group_head, test_head, "right")
    upto = np.cumsum(hi - lo)
    best: list[np.ndarray] = []  # rows of (document, passage, -words, place in document, place in passage)
    x = 0
    while x < len(test.starts):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + PAIRS, "right")))
        many = (hi - lo)[x:y]
        t = np.repeat(test.starts[x:y], many)
        g = np.repeat(lo[x:y] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at = np.searchsorted(key, g * (s.n + 1) + s.rank[t], "left")  # bisection in the suffix array
        left, right = at - 1, at
        has_left = (left >= 0) & (group[np.maximum(left, 0)] == g)
        has_right = (right < len(train)) & (group[np.minimum(right, len(train) - 1)] == g)
        rows = []
        for near, has in ((left, has_left), (right, has_right)):
            e, u = train[near[has]], t[has]
            d, p = group_doc[g[has]], test.owner[u]
            begin = np.r_[0, doc_ends + 1][d]
            rows.append(np.stack([d, p, -s.common(e, u), place[e - m] - begin, u - np.array(test.first)[p]]))
        best = [_first_of_each(np.concatenate(best + rows, axis=1))]
        x = y
    return [(kept[d][0], *test.names[p], -w, i, j) for d, p, w, i, j in best[0].T.tolist()]


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """The best column for each (document, passage)."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.r_[True, (np.diff(rows[:2], axis=1) != 0).any(0)]] if rows.shape[1] else rows


def find_leaks(docs: DataFrame, questions: DataFrame, min_words: int = 12, fields: tuple[str, ...] = ("question", "contains")) -> DataFrame:
    """``doc_id, qid, field, words, doc_word, test_word``: the longest match of each document with each
    passage of which it repeats ``min_words`` words or more, and where it stands in both."""
    spark = docs.sparkSession
    long = questions.select("qid", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("p"))
    long = long.filter(F.col("qid").isNotNull() & F.col("p.text").isNotNull()).select("qid", "p.field", "p.text").distinct()
    size = long.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // (4 * MAX_TEST_WORDS)))
    rows = spread(docs.select("doc_id", "text").filter(F.col("text").isNotNull()))
    out = None
    for part in range(parts):  # one part unless the test set is larger than may be broadcast
        some = long if parts == 1 else long.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
        passages = sorted((r["qid"], r["field"], r["text"]) for r in some.collect())
        sent = spark.sparkContext.broadcast(passages)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterable[pa.RecordBatch]:
            test = TestSet(sent.value, min_words)
            shard: list[tuple[int, str | None]] = []
            size = 0

            def result() -> pa.RecordBatch:
                cols = list(zip(*search(test, shard))) or [[]] * 6
                types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                shard.clear()
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "qid", "field", "words", "doc_word", "test_word"])

            for b in batches:
                for d, t in zip(b[0].to_pylist(), b[1].to_pylist()):
                    shard.append((d, t))
                    size += len(t)
                    if size >= SHARD_CHARS:
                        yield result()
                        size = 0
            if shard:
                yield result()

        found = rows.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def leaked_items(found: DataFrame) -> DataFrame:
    """``qid, documents, longest``: which test items leaked, into how many documents."""
    return found.groupBy("qid").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))


def without_leaks(docs: DataFrame, found: DataFrame, broadcast_ids: int = 200_000) -> DataFrame:
    """The documents of which no row of ``found`` names the doc_id, with all their columns and copies.

    Ids are broadcast, so that texts don't cross the network, if their number was checked to be at most
    ``broadcast_ids``; beyond it they are joined. If a document without doc_id leaks, all without one go.
    """
    ids = cut_lineage(found.select(F.col("doc_id").alias("_leaked")).distinct())
    side = F.broadcast(ids) if ids.count() <= broadcast_ids else ids.hint("shuffle_merge")
    return docs.join(side, docs["doc_id"].eqNullSafe(F.col("_leaked")), "left_anti")
