"""Dense retrieval: hashed text vectors, cosine search in tiles, and a registry of embedders.

A zero vector (blank text) never ranks; only cosines above 0 do. Ties, after rounding to nine places,
go to the smaller id.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import STOPWORDS, TOKEN
from lodestone.session import cut_lineage, spread

_find = re.compile(TOKEN).findall
_stop = frozenset(STOPWORDS)
#: Queries held by a task at once; more are searched in parts.
QUERIES = 4_096


def stem(t: str) -> str:
    """``functions.text.stem`` for code that runs on Arrow batches."""
    if len(t) <= 3 or not (t.isascii() and t.isalpha()):
        return t
    if t[-3:] == "ies" and len(t) >= 6:
        t = t[:-3] + "y"
    elif t[-3:] == "ing" and len(t) >= 6:
        t = t[:-3]
    elif t[-2:] == "ed" and len(t) >= 5:
        t = t[:-2]
    elif t[-1] == "s" and t[-2:] not in ("ss", "us", "is"):
        t = t[:-1]
    return t[:-1] if len(t) > 4 and t[-1] == "e" else t


def tokens(text: str) -> list[str]:
    return [stem(t) for t in _find(text.lower()) if t not in _stop]


class HashingEmbedder:
    """Words, padded character trigrams and word pairs, hashed with signs into ``dim`` buckets.

    Weights 1, 0.3 and 0.7 are summed per feature, dampened by log1p and scaled to unit length.
    Bucket and sign come from an 8-byte blake2b. Features are numbered as they are met; a worker
    remembers numbers, buckets and the features of each word, and sums a batch in numpy.
    """

    WEIGHTS = {"w": 1.0, "c": 0.3, "b": 0.7}
    MEMORY = 2_000_000

    def __init__(self, dim: int = 1024):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim, self.name = dim, f"hash:{dim}"
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.of_word: dict[str, list[int]] = {}
        self.bucket: list[int] = []
        self.sign: list[float] = []
        self.unit: list[float] = []

    def feature(self, name: str) -> int:
        k = self.number.get(name)
        if k is None:
            h = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
            k = self.number[name] = len(self.bucket)
            self.bucket.append(h % self.dim)
            self.sign.append(1.0 if h >> 63 else -1.0)
            self.unit.append(self.WEIGHTS[name[0]])
        return k

    def word_features(self, w: str) -> list[int]:
        got = self.of_word.get(w)
        if got is None:
            p = f"<{w}>"
            got = self.of_word[w] = [self.feature("w:" + w), *(self.feature("c:" + p[i : i + 3]) for i in range(len(p) - 2))]
        return got

    def embed(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > self.MEMORY:
            self.reset()
        n = len(texts)
        found: list[int] = []
        sizes = np.zeros(n, np.int64)
        for k, text in enumerate(texts):
            before = len(found)
            words = tokens(text) if text else []
            for w in words:
                found += self.word_features(w)
            found += [self.feature(f"b:{x} {y}") for x, y in zip(words, words[1:])]
            sizes[k] = len(found) - before
        key, count = np.unique(np.repeat(np.arange(n), sizes) << 32 | np.array(found, np.int64), return_counts=True)
        row, f = key >> 32, key & 0xFFFFFFFF
        value = np.array(self.sign)[f] * np.log1p(count * np.array(self.unit)[f]) if len(f) else np.zeros(0)
        cell = row * self.dim + np.array(self.bucket, np.int64)[f] if len(f) else np.zeros(0, np.int64)
        v = np.bincount(cell, value, n * self.dim).reshape(n, self.dim)
        norm = np.sqrt((v * v).sum(1))
        norm[norm == 0] = 1.0
        return (v / norm[:, None]).astype(np.float32)


class WordEmbedder:
    """Stemmed words alone, hashed by MD5: bucket from the first 28 bits, sign from the next four.

    Coarser than ``HashingEmbedder``, but SQL can follow it to the last digit."""

    def __init__(self, dim: int = 256):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim, self.name = dim, f"words:{dim}"
        self.place: dict[str, tuple[int, float]] = {}

    def of(self, word: str) -> tuple[int, float]:
        got = self.place.get(word)
        if got is None:
            h = hashlib.md5(word.encode()).hexdigest()
            if len(self.place) > HashingEmbedder.MEMORY:
                self.place.clear()
            got = self.place[word] = (int(h[:7], 16) % self.dim, 1.0 if int(h[7], 16) < 8 else -1.0)
        return got

    def embed(self, texts: list[str | None]) -> np.ndarray:
        v = np.zeros((len(texts), self.dim))
        for row, text in zip(v, texts):
            for w, n in Counter(tokens(text or "")).items():
                at, sign = self.of(w)
                row[at] += sign * np.log1p(n)
        norm = np.sqrt((v * v).sum(1))
        return (v / np.where(norm > 1e-9, norm, 1.0)[:, None]).astype(np.float32)


def _model_embedder(name: str):
    class ModelEmbedder:
        def __init__(self) -> None:
            from sentence_transformers import SentenceTransformer  # optional

            self.model, self.name = SentenceTransformer(name), f"st:{name}"

        def embed(self, texts: list[str | None]) -> np.ndarray:
            return np.asarray(self.model.encode([t or "" for t in texts], normalize_embeddings=True), np.float32)

    return ModelEmbedder()


#: Embedders by the part of their name before the colon; add to it to plug in others.
EMBEDDERS: dict[str, Callable[[str], object]] = {"hash": lambda arg: HashingEmbedder(int(arg or 1024)), "words": lambda arg: WordEmbedder(int(arg or 256)), "st": _model_embedder}
_made: dict[str, object] = {}


def embedder(name: str = "hash:1024"):
    """The embedder of a name; made once per process."""
    if name not in _made:
        kind, _, arg = name.partition(":")
        if kind not in EMBEDDERS:
            raise ValueError(f"unknown embedder {name!r}; use one of {sorted(EMBEDDERS)}")
        _made[name] = EMBEDDERS[kind](arg)
    return _made[name]


def embed(rows: DataFrame, text: Column | str, name: str = "hash:1024", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``<keep>, vector``: vectors of the texts, by Arrow batches."""
    embedder(name)
    source = rows.select(*keep, F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).alias("text"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "vector array<float>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        e = embedder(name)
        for b in batches:
            for x in range(0, b.num_rows, 2000):
                part = b.slice(x, 2000)
                v = e.embed(part[len(keep)].to_pylist())
                flat = pa.array(v.ravel(), pa.float32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], [*keep, "vector"])

    return spread(source).mapInArrow(run, schema)


def best_cosines(unit: np.ndarray, ids: list, queries: np.ndarray, qids: list, k: int) -> tuple[list, list, list]:
    """Per query the k best of a tile, with cosine above 0."""
    out: tuple[list, list, list] = ([], [], [])
    if not len(unit) or not len(queries):
        return out
    s = queries @ unit.T
    keep = min(k + 8, s.shape[1])  # some more, so that ties are settled by id
    part = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    for q, cols in enumerate(part):
        row = s[q, cols]
        order = sorted((-round(float(c), 9), ids[j], float(c)) for c, j in zip(row, cols) if c > 0)
        edge = -order[k - 1][0] if len(order) >= k else 0.0
        if len(order) == keep and keep < s.shape[1] and -order[-1][0] == edge:  # a tie reaches over the cut
            more = np.flatnonzero(np.round(s[q], 9) >= edge)
            order = sorted((-round(float(s[q, j]), 9), ids[j], float(s[q, j])) for j in more if s[q, j] > 0)
        for _, i, c in order[:k]:
            out[0].append(qids[q])
            out[1].append(i)
            out[2].append(c)
    return out


def unit_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit float64 rows of a list column, and which rows they are; zero, null and NaN vectors fall out."""
    lists = col.to_pylist() if col.null_count else None
    lengths = np.asarray(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    width = int(np.bincount(lengths).argmax()) if len(lengths) and lengths.max() else 0
    at = np.flatnonzero(lengths == width) if width else np.zeros(0, int)
    if not len(at):
        return np.zeros((0, 1)), at
    del lists
    v = np.asarray(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), width)
    norm = np.sqrt((v * v).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return v[good] / norm[good, None], at[good]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """``qid, id, score, rank``: the k most similar of ``vectors`` (id, vector) for each query (qid, vector).

    Queries go to the tasks in parts of at most ``QUERIES`` rows, a bound on what is broadcast; each
    batch of vectors is one matrix product and hands on k candidates a query.
    """
    if allowed is not None:
        vectors = vectors.join(allowed, "id", "left_semi")
    spark = vectors.sparkSession
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "qid"), (vectors, "id"))}
    schema = f"qid {kinds['qid']}, id {kinds['id']}, score double"
    n = queries.count()
    parts = max(1, -(-n // QUERIES))
    if parts > 1:  # every part reads the vectors; they aren't made again for each
        vectors = cut_lineage(vectors)
    found = None
    for p in range(parts):
        some = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p)
        local = some.select("qid", "vector").toArrow()
        q, at = unit_rows(local["vector"].combine_chunks()) if local.num_rows else (np.zeros((0, 1)), [])
        qids = [local["qid"][int(i)].as_py() for i in at]
        sent = spark.sparkContext.broadcast((q, qids, local.schema.field("qid").type))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterable[pa.RecordBatch]:
            q, qids, kind = sent.value
            for b in batches:
                for x in range(0, b.num_rows, 4096):
                    part = b.slice(x, 4096)
                    u, at = unit_rows(part[1])
                    if len(u) and len(q) and u.shape[1] == q.shape[1]:
                        ids = part[0].take(pa.array(at)).to_pylist()
                        if len(set(ids)) < len(ids):  # repeated rows would take the places of others
                            once = list({(i, v.tobytes()): x for x, (i, v) in enumerate(zip(ids, u))}.values())
                            u, ids = u[once], [ids[x] for x in once]
                        a, i, s = best_cosines(u, ids, q, qids, k)
                        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(i, part[0].type), pa.array(s, pa.float64())], ["qid", "id", "score"])

        part = spread(vectors.select("id", "vector")).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("id"))
    return found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors of unit length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
