"""Search of many questions at once: first stage, fusion, reranking, filters and several wordings."""

from __future__ import annotations

from collections.abc import Collection as Collection_
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, dense, fusion, rerank
from lodestone.operators.index import as_documents, small
from lodestone.session import cut_lineage

MODES = ("bm25", "dense", "hybrid")
DEPTH = 50
DEFAULT_MODES = ("bm25", "dense", "hybrid", "hybrid+proximity", "hybrid+mmr")


@dataclass(frozen=True)
class Mode:
    retriever: str
    reranker: str | None = None
    multi: bool = False

    @classmethod
    def parse(cls, spec: str, rewriter: bool = False) -> Mode:
        """``retriever[+reranker][+multi]``; ``multi`` needs something that rewrites questions."""
        name, *extras = spec.split("+")
        multi, extras = "multi" in extras, [e for e in extras if e != "multi"]
        if name not in MODES or len(extras) > 1 or any(e not in rerank.RERANKERS for e in extras):
            raise ValueError(f"unknown mode {spec!r}; use one of {MODES}, with +{' or +'.join(rerank.RERANKERS)} and +multi if wanted")
        if multi and not rewriter:
            raise ValueError(f"{spec!r} needs a rewriting backend")
        return cls(name, extras[0] if extras else None, multi)


@dataclass
class Rankings:
    """Rankings of the same questions by retriever, cut at ``depth``, and the postings they came from."""

    depth: int
    by: dict[str, DataFrame]
    postings: bm25.Postings


class Collection:
    """Chunks (id, source, title, heading, text) and what searches need of them, each made once.

    Stored postings, statistics and vectors are used if they are given; else they are derived."""

    def __init__(self, chunks: DataFrame, embedder: str = "hash:1024", vectors: DataFrame | None = None, tf: DataFrame | None = None, stats: DataFrame | None = None):
        dense.embedder(embedder)
        self.chunks, self.embedder = chunks, embedder
        self._vectors, self._tf, self._stats = vectors, tf, stats

    @cached_property
    def docs(self) -> DataFrame:
        return as_documents(self.chunks)

    def docs_of(self, ids: DataFrame) -> DataFrame:
        """``id, text`` of some chunks; the others never leave the scan."""
        wanted = small(ids.select("id").distinct())
        rows = self.chunks.join(wanted, "id", "left_semi")
        return rows.select("id", T.indexed_text().alias("text")).distinct()

    @cached_property
    def vectors(self) -> DataFrame:
        return self._vectors if self._vectors is not None else dense.embed(self.docs, "text", self.embedder)

    def vectors_of(self, ids: DataFrame) -> DataFrame:
        """Vectors of some chunks; if none are stored, only these are embedded."""
        if self._vectors is not None:
            return self._vectors.join(small(ids.select("id").distinct()), "id", "left_semi")
        return dense.embed(self.docs_of(ids), "text", self.embedder)

    def postings(self, questions: DataFrame) -> bm25.Postings:
        if self._tf is None or self._stats is None:
            return bm25.asked_postings(self.docs, questions)
        return bm25.stored_postings(self._tf, self._stats, questions)

    # rankings: qid, id, score, rank ----------------------------------------------------------
    def lexical(self, questions: DataFrame, n: int, allowed: DataFrame | None = None, postings: bm25.Postings | None = None) -> DataFrame:
        return bm25.search(self.docs, questions, n, allowed, postings=postings or self.postings(questions))

    def dense(self, questions: DataFrame, n: int, allowed: DataFrame | None = None) -> DataFrame:
        q = dense.embed(questions, "question", self.embedder, keep=("qid",))
        return dense.search(self.vectors, q, n, allowed)

    def first_stage(self, questions: DataFrame, n: int, mode: str, allowed: DataFrame | None = None, lists: Rankings | None = None) -> DataFrame:
        """``qid, id, score, rank, ranks``. Rankings at hand of at least the depth needed are cut, not made again."""
        get = lambda name, depth: self.cut(lists, name, questions, depth, allowed)
        if mode == "hybrid":
            depth = max(n, DEPTH)
            return fusion.top(fusion.rrf({"bm25": get("bm25", depth), "dense": get("dense", depth)}), n)
        one = get(mode, n)
        return one.select("qid", "id", "score", "rank", F.create_map(F.lit(mode), F.col("rank").cast("int")).alias("ranks"))

    def cut(self, lists: Rankings | None, name: str, questions: DataFrame, depth: int, allowed: DataFrame | None) -> DataFrame:
        if lists is not None and depth <= lists.depth and name in lists.by:
            return lists.by[name].filter(F.col("rank") <= depth)
        return self.lexical(questions, depth, allowed, lists.postings if lists else None) if name == "bm25" else self.dense(questions, depth, allowed)

    def rankings(self, questions: DataFrame, names: Collection_[str] = ("bm25", "dense"), depth: int = DEPTH, allowed: DataFrame | None = None) -> Rankings:
        """The retrievers' rankings, each made once for several modes: depth rows a question, written out."""
        questions = questions.select("qid", "question").filter(F.trim(F.coalesce("question", F.lit(""))) != "")
        posts = self.postings(questions)
        by = {n: cut_lineage((self.lexical(questions, depth, allowed, posts) if n == "bm25" else self.dense(questions, depth, allowed)).select("qid", "id", "score", "rank")) for n in names}
        return Rankings(depth, by, posts)

    def rerank(self, questions: DataFrame, pool: DataFrame, k: int, how: str, postings: bm25.Postings | None = None) -> DataFrame:
        pool = cut_lineage(pool)  # at most POOL rows a question, used several times
        if how == "mmr":
            out = rerank.mmr(pool, self.vectors_of(pool), k)
            return out.join(pool.select("qid", "id", "ranks"), ["qid", "id"], "left")
        p = postings or self.postings(questions)
        close = rerank.proximity_ranks(self.docs_of(pool), questions, pool, p)
        fused = fusion.top(fusion.rrf({"first": pool, "proximity": close}), k)
        first = pool.select("qid", "id", F.col("ranks").alias("before"))
        joined = fused.join(first, ["qid", "id"], "left")
        ranks = F.map_concat("before", F.map_filter("ranks", lambda name, _: name == "proximity"))
        return joined.select("qid", "id", "score", "rank", ranks.alias("ranks"))

    def search(self, questions: DataFrame, k: int = 5, mode: str = "hybrid", reranker: str | None = None, allowed: DataFrame | None = None, lists: Rankings | None = None) -> DataFrame:
        """``qid, id, score, rank, ranks`` for each question (qid, question). Blank questions find nothing."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if reranker is not None and reranker not in rerank.RERANKERS:
            raise ValueError(f"reranker must be one of {rerank.RERANKERS}")
        if k < 1:
            raise ValueError("k must be positive")
        questions = questions.select("qid", "question").filter(F.trim(F.coalesce("question", F.lit(""))) != "")
        if reranker is None:
            return self.first_stage(questions, k, mode, allowed, lists)
        pool = self.first_stage(questions, max(k, rerank.POOL), mode, allowed, lists)
        return self.rerank(questions, pool, k, reranker, lists.postings if lists else None)

    def multi_search(self, wordings: DataFrame, k: int = 5, mode: str = "hybrid", reranker: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """As ``search`` for questions of several wordings (qid, n, question), fused as ``q1``, ``q2`` ...

        A question with one wording keeps its plain ranking and scores."""
        key = F.concat_ws("\x1f", F.col("qid").cast("string"), F.col("n").cast("string"))
        kind = wordings.schema["qid"].dataType.simpleString()
        flat = wordings.select(key.alias("qid"), "question")
        found = self.search(flat, max(k, rerank.POOL), mode, reranker, allowed)
        parts = F.split("qid", "\x1f")
        found = found.select(F.get(parts, F.lit(0)).cast(kind).alias("qid"), F.get(parts, F.lit(1)).cast("int").alias("n"), "id", "score", "rank", "ranks")
        counts = wordings.groupBy("qid").agg(F.count("*").alias("wordings"))
        found = found.join(F.broadcast(counts) if counts.count() < 100_000 else counts, "qid")
        single = found.filter((F.col("wordings") == 1) & (F.col("rank") <= k)).select("qid", "id", "score", "rank", "ranks")
        several = found.filter(F.col("wordings") > 1).withColumn("ranking", F.concat(F.lit("q"), F.col("n")))
        fused = fusion.top(fusion.fuse(several), k).select("qid", "id", "score", "rank", "ranks")
        return single.unionByName(fused)

    def hits(self, ranking: DataFrame) -> DataFrame:
        """The ranking with its chunks, joined after the cut: only texts of hits leave the scan.

        Of several rows of one id the first by source, title, heading and text counts."""
        ranking = cut_lineage(ranking)
        fields = ("source", "title", "heading", "text")
        wanted = small(ranking.select("id").distinct())
        first = F.min(F.struct(*fields)).alias("c")
        payload = self.chunks.join(wanted, "id", "left_semi").groupBy("id").agg(first)
        return ranking.join(payload, "id").select(*ranking.columns, *[F.col(f"c.{c}").alias(c) for c in fields])
