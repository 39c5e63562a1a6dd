"""The engine's Python API: an index folder, ingest and maintenance, search, answers, evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.backends import ChatBackend, failure
from lodestone.functions import text as T
from lodestone.operators import answer as A
from lodestone.operators import evaluate as E
from lodestone.operators import ingest as I
from lodestone.operators.filters import allowed_chunks
from lodestone.operators.search import DEFAULT_MODES, Collection, Mode
from lodestone.operators.store import Store
from lodestone.session import cut_lineage
from lodestone.sources import loaders
from lodestone.sources.chunker import chunk_documents

Rewriter = Callable[[str], str]
Condenser = Callable[[str, list[str]], str]


@dataclass
class IngestResult:
    """What an ingest did. ``actions`` (action, source, owner) has a row per document; the lists below read
    their part of it when they are asked for, and are meant for small batches."""

    counts: dict[str, int]
    chunks: int
    actions: DataFrame
    unreadable: DataFrame | None = None

    def names(self, action: str) -> list[str]:
        return [r["source"] for r in self.actions.filter(F.col("action") == action).orderBy("source").toLocalIterator()]

    added = property(lambda self: self.names("added"))
    updated = property(lambda self: self.names("updated"))
    unchanged = property(lambda self: self.names("unchanged"))
    removed = property(lambda self: self.names("removed"))

    @property
    def conflicts(self) -> dict[str, str]:
        return {r["source"]: r["owner"] for r in self.actions.filter("action = 'conflict'").orderBy("source").toLocalIterator()}


class Engine:
    """``answers(question, hits)``, ``rewrite(question)`` and ``condenser(question, history)`` are callables, or
    methods of a ``backends.ChatBackend``; ``streamed(question, hits)`` gives an answer in pieces."""

    def __init__(
        self, spark: SparkSession, path: str, embedder: str | None = None, answers: A.Backend | None = None, rewrite: Rewriter | None = None, condenser: Condenser | None = None,
        streamed: Callable[[str, list[dict]], Iterator[str]] | None = None,
    ):
        self.spark, self.store = spark, Store(spark, path, embedder)
        self.answers, self.rewrite, self.condenser, self.streamed = answers, rewrite, condenser, streamed
        self._at: str | None = None
        self._collection: Collection | None = None

    @classmethod
    def with_backend(cls, spark: SparkSession, path: str, backend: ChatBackend | None, embedder: str | None = None) -> Engine:
        if backend is None:
            return cls(spark, path, embedder)
        return cls(spark, path, embedder, backend.answers, backend.rewrite, backend.condense, backend.streamed)

    # ingest and maintenance ----------------------------------------------------------------------
    def ingest(self, docs: DataFrame, origin: str = "", tags: Sequence[str] | None = None, prune: bool = False, prefix: str = "", max_chars: int = 800, overlap: int = 150) -> IngestResult:
        """Upsert documents (source, title, text). Only new and changed ones are chunked, embedded and written;
        tags, if given, replace those of every document in the batch; ``prune`` drops the origin's
        documents that the batch no longer has. Of several rows of one source the last by title and text
        counts. A batch that changes nothing writes nothing."""
        if overlap >= max_chars:
            raise ValueError("overlap must be smaller than max_chars")
        wanted = None if tags is None else I.check_tags(list(tags))
        name = F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("source")) if prefix else F.col("source")
        docs = docs.select(name.alias("source"), "title", "text", F.lit(origin).alias("origin"))
        docs = docs.groupBy("source", "origin").agg(F.max(F.struct("title", "text")).alias("d")).select("source", "d.title", "d.text", "origin")
        old = self.store.table("documents")
        plan = cut_lineage(I.classify(docs, old, max_chars, overlap))
        mine = plan.filter(F.col("action") != "conflict")
        # sources of a conflict are not the batch's own, so pruning doesn't keep them
        gone = I.pruned(old, mine, self.spark.createDataFrame([(origin,)], "origin string")) if prune else self.spark.createDataFrame([], "source string")
        gone = cut_lineage(gone.select("source"))
        now = F.lit(datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)).cast("timestamp")
        before = old.select("source", F.col("tags").alias("_tags"), F.col("ingested_at").alias("_at"), F.col("origin").alias("_origin"))
        new_tags = F.array(*[F.lit(t) for t in wanted]).cast("array<string>") if wanted is not None else F.coalesce("_tags", F.array().cast("array<string>"))
        rows = mine.join(before, "source", "left").withColumn("tags", new_tags)
        as_it_was = (F.col("action") == "unchanged") & F.col("_tags").eqNullSafe(F.col("tags")) & F.col("_origin").eqNullSafe(F.col("origin"))
        fresh = rows.filter(~as_it_was).select("source", "title", "origin", "hash", F.when(F.col("action") == "unchanged", F.col("_at")).otherwise(now).alias("ingested_at"), "tags", "action")
        fresh = cut_lineage(fresh)
        changed = mine.filter(F.col("action").isin("added", "updated"))
        chunks = 0
        if not (fresh.isEmpty() and gone.isEmpty()):
            void = fresh.filter("action <> 'added'").select("source", (F.col("action") == "updated").alias("chunks")).unionByName(gone.withColumn("chunks", F.lit(True)))
            pieces = None if changed.isEmpty() else chunk_documents(changed, max_chars, overlap)
            chunks = self.store.append(None if fresh.isEmpty() else fresh, pieces, None if void.isEmpty() else void)
        actions = plan.select("action", "source", "owner").unionByName(gone.select(F.lit("removed").alias("action"), "source", F.lit(None).cast("string").alias("owner")))
        counts = dict.fromkeys(("added", "updated", "unchanged", "removed", "conflict"), 0) | {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        return IngestResult(counts, chunks, actions)

    def ingest_path(self, target: str, **options) -> IngestResult:
        """A folder, file or address; only folders may be pruned. What could not be read is in ``unreadable``
        (source, error); such files count as missing, not as removed."""
        docs, errors = loaders.documents(self.spark, target)
        errors = cut_lineage(errors)
        broken = not errors.isEmpty()
        if options.get("prune") and (target.startswith(("http://", "https://")) or broken):
            options = {**options, "prune": False}  # a file that can't be read now is no reason to drop its document
        result = self.ingest(docs, origin=options.pop("origin", target.rstrip("/")), **options)
        return replace(result, unreadable=errors if broken else None)

    def remove(self, targets: Sequence[str]) -> DataFrame:
        """Drop the documents that the targets name; gives their ``source``, a row each."""
        documents = self.store.table("documents").select("source", "origin")
        hit = self.spark.createDataFrame([], "source string")
        for t in targets:
            hit = hit.unionByName(I.find_sources(documents, t))
        hit = cut_lineage(hit.distinct())
        if not hit.isEmpty():
            self.store.append(gone=hit.withColumn("chunks", F.lit(True)))
        return hit

    def reset(self) -> None:
        self.store.reset()

    def vacuum(self) -> tuple[int, int]:
        return self.store.vacuum()

    def stats(self) -> DataFrame:
        return I.document_stats(self.store.table("chunks"), self.store.table("documents"))

    def sources(self) -> DataFrame:
        return self.store.table("chunks").select("source").distinct().orderBy("source")

    # search ---------------------------------------------------------------------------------------
    def collection(self) -> Collection:
        """What searches read; made anew when the pointer has moved."""
        v = self.store.version()
        if self._collection is None or v != self._at:
            s = self.store
            self._collection = Collection(s.table("chunks"), s.embedder, s.table("vectors"), s.table("postings"), s.stats())
            self._at = v
        return self._collection

    def search(self, questions: DataFrame, k: int = 5, mode: str = "hybrid", rerank: str | None = None, sources: Sequence[str] = (), tags: Sequence[str] = (), multi: bool = False, llm: bool = True) -> DataFrame:
        """Hits (qid, id, source, title, heading, text, score, rank, ranks) of questions (qid, question, history)."""
        c = self.collection()
        questions = self.condensed(questions, llm)
        allowed = allowed_chunks(c.chunks, self.store.table("documents"), sources, tags)
        if multi and llm and self.rewrite is not None:
            return c.hits(c.multi_search(self.wordings(questions), k, mode, rerank, allowed))
        return c.hits(c.search(questions, k, mode, rerank, allowed))

    def condensed(self, questions: DataFrame, llm: bool = True) -> DataFrame:
        """Questions that stand alone, and a ``note`` where the backend failed and words were carried over instead."""
        if "history" not in questions.columns:
            return questions
        plain = T.condense("question", "history")
        if self.condenser is None or not llm:
            return cut_lineage(questions.withColumn("question", plain).drop("history"))
        fn = self.condenser

        def one(row: tuple[str, list[str] | None]) -> tuple[str | None, str | None]:
            kept = [h for h in (row[1] if row[1] is not None else []) if h and h.strip()][-10:]
            if not kept:
                return row[0], None
            try:
                return (fn(row[0], kept) or "").strip().splitlines()[0].strip(), None
            except Exception as e:
                return None, f"{failure(e)}; took over words of the earlier questions"

        @F.pandas_udf("question string, note string")
        def asked(question: pd.Series, history: pd.Series) -> pd.DataFrame:
            with ThreadPoolExecutor(A.CALLS) as pool:
                return pd.DataFrame(list(pool.map(one, zip(question, history))), columns=["question", "note"])

        rows = questions.withColumn("_b", asked("question", "history"))
        return cut_lineage(rows.withColumn("question", F.coalesce("_b.question", plain)).withColumn("note", F.col("_b.note")).drop("history", "_b"))

    def wordings(self, questions: DataFrame) -> DataFrame:
        """``qid, n, question``: each question and its rewrites, at most four; a failing rewriter gives none."""
        fn = self.rewrite

        def one(q: str) -> str:
            try:
                return (fn(q) if fn else "") or ""
            except Exception:  # the question as written is searched
                return ""

        @F.pandas_udf("string")
        def reply(question: pd.Series) -> pd.Series:
            with ThreadPoolExecutor(A.CALLS) as pool:
                return pd.Series(list(pool.map(one, question)), dtype=object)

        lists = cut_lineage(questions.select("qid", T.clean_rewrites(F.trim("question"), F.coalesce(reply("question"), F.lit(""))).alias("w")))
        return lists.select("qid", F.posexplode("w").alias("n", "question")).withColumn("n", F.col("n") + 1)

    def answer(self, questions: DataFrame, llm: bool = True, **options) -> DataFrame:
        asked = self.condensed(questions, llm)
        return A.answer(asked, self.search(asked, llm=llm, **options), self.answers if llm else None)

    def _one(self, question: str, history: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(0, question, list(history))], "qid bigint, question string, history array<string>")

    def ask(self, question: str, history: Sequence[str] = (), llm: bool = True, **options) -> dict:
        """One question, answered; ``llm=False`` leaves the backends alone."""
        row = self.answer(self._one(question, history), llm, **options).first()
        return row.asDict(recursive=True) if row else {"question": question, "answer": A.NO_ANSWER, "sources": [], "mode": "extractive", "warning": None}

    def stream(self, question: str, history: Sequence[str] = (), llm: bool = True, **options) -> Iterator[tuple[str, dict]]:
        """As ``ask``, as events; the last one tells the question that was answered."""
        q = self.condensed(self._one(question, history), llm)
        hits = [r.asDict(recursive=True) for r in self.search(q, llm=llm, **options).orderBy("rank").collect()]  # k rows
        asked = q.first().asDict()
        for name, data in A.stream(asked["question"], hits, self.streamed if llm else None):
            yield name, {**data, "question": asked["question"], "warning": data["warning"] or asked.get("note")} if name == "done" else data

    def converse(self, turns: DataFrame, **options) -> DataFrame:
        """Answers of conversations (conv_id, turn, question): every turn is condensed with those before it."""
        from pyspark.sql import Window

        w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-10, -1)
        rows = turns.select("conv_id", "turn", "question", F.collect_list("question").over(w).alias("history"))
        key = F.concat_ws("\x1f", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        out = self.answer(rows.select(key.alias("qid"), "question", "history"), **options)
        parts = F.split("qid", "\x1f")
        kinds = dict(turns.dtypes)
        return out.select(F.get(parts, F.lit(0)).cast(kinds["conv_id"]).alias("conv_id"), F.get(parts, F.lit(1)).cast(kinds["turn"]).alias("turn"), "question", "answer", "mode", "warning", "sources")

    # evaluation -----------------------------------------------------------------------------------
    def evaluate(self, questions: DataFrame, ks: Sequence[int] = (1, 3, 5), modes: Sequence[str] = DEFAULT_MODES) -> DataFrame:
        return E.evaluate(self.collection(), questions, ks, modes)

    def evaluate_answers(self, questions: DataFrame, mode: str = "hybrid", k: int = 5, llm: bool = True) -> DataFrame:
        m = Mode.parse(mode, self.rewrite is not None)
        asked = self.condensed(questions, llm)
        answers = A.answer(asked, self.search(asked, k, m.retriever, m.reranker, multi=m.multi, llm=llm))
        return E.answer_summary(E.answer_quality(answers, questions))

    def judge(self, questions: DataFrame, mode: str = "hybrid", k: int = 5, backend=None, llm: bool = True) -> DataFrame:
        m = Mode.parse(mode, self.rewrite is not None)
        answers = self.answer(questions, llm, k=k, mode=m.retriever, rerank=m.reranker, multi=m.multi)
        return E.judge(answers, questions, backend if llm else None)


def to_json(rows: Sequence[Row] | IngestResult | dict) -> str:
    """JSON of results for the command line and the service."""
    if isinstance(rows, IngestResult):
        return json.dumps({**rows.counts, "chunks": rows.chunks}, ensure_ascii=False)
    if isinstance(rows, dict):
        return json.dumps(rows, ensure_ascii=False, default=str)
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, default=str)
