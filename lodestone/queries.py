"""Queries of the core operators, over their whole tables, with the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.engine import Engine, IngestResult
from lodestone.functions import text as T
from lodestone.functions.register import register
from lodestone.operators import answer as A
from lodestone.operators import bm25, dense, evaluate, fusion, incremental, ingest, rerank
from lodestone.operators.filters import allowed_chunks, has_tags, source_matches
from lodestone.operators.index import as_documents, corpus_stats, document_frequency, idf, postings, record_lengths
from lodestone.operators.search import Collection
from lodestone.plans import requests
from lodestone.operators.store import TABLES, Store
from lodestone.session import checkpoint_folder, cut_lineage, distinct_rows, spread, table
from lodestone.sources.chunker import chunk_documents
from lodestone.sources.html import html_to_markdown

_BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
TAGS, GLOBS = ("guide", "ops"), ("guides/*", "s?k/*.md", "[f-l]*/r*")
MODES = ("bm25", "dense", "hybrid", "hybrid+proximity", "hybrid+mmr")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return as_documents(table(spark, sf, "chunks"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


# text --------------------------------------------------------------------------------------------
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return record_lengths(_docs(spark, sf))


def token_stream(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "questions").select("qid", F.posexplode(T.tokens("question")).alias("pos", "token"))


def stem_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return postings(_docs(spark, sf)).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = distinct_rows(spread(table(spark, sf, "chunks").select("id", "text").filter(F.col("text").isNotNull())))
    return rows.select("id", F.size(T.split_sentences("text")).alias("sentences"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ingest.content_hash().alias("hash"))


def tags_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.normalize_tags(F.coalesce("tags", F.array().cast("array<string>"))), ",").alias("tags"))


def heading_promotion(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "documents").filter(F.col("text").isNotNull()))
    return rows.select("doc_id", F.md5(T.heading_promotion("text")).alias("promoted"))


def extract_title(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.regexp_extract("source", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return table(spark, sf, "documents").select("doc_id", T.markdown_title(F.coalesce("text", F.lit("")), stem).alias("title"))


def follow_up_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "asks").select("ask_id", F.coalesce(T.is_follow_up("question"), F.lit(False)).alias("follow_up"))


def condense_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "asks").select("ask_id", T.condense("question", "history").alias("standalone"))


def ask_requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "asks").select("ask_id", requests.problem().alias("problem"))


# sources -----------------------------------------------------------------------------------------
def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    """HTML deliveries as Markdown."""
    rows = spread(table(spark, sf, "documents").filter(F.lower("text").contains("<html")).select("doc_id", "text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [html_to_markdown(t) for t in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["doc_id", "title", "markdown"])

    return rows.mapInArrow(run, "doc_id bigint, title string, markdown string")


def chunked_documents(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk_documents(table(spark, sf, "documents"), keep=("doc_id",))
    return chunks.select("doc_id", "position", "heading", "text")


def chunk_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document's chunks: whether they are within the limit (a table or code line may be longer), are
    numbered from 0 and repeat no more than the overlap allows, and how many different words they hold. A
    document with an unbroken run of 700 characters, which may be cut, has -1 words."""
    docs = table(spark, sf, "documents").filter(F.col("text").isNotNull())
    chunks = chunk_documents(docs, keep=("doc_id",)).select("doc_id", "position", "text")
    fits = (F.length("text") <= 800) | F.col("text").rlike(r"[|]|```|~~~")
    per = chunks.groupBy("doc_id").agg(F.every(fits).alias("fits"), (F.max("position") + 1 == F.count("*")).alias("numbered"))
    words = chunks.select("doc_id", F.explode(F.split("text", _BLANKS)).alias("w")).filter("w <> ''").groupBy("doc_id").agg(F.countDistinct("w").alias("words"))
    runs = docs.select("doc_id", F.col("text").rlike(r"\S{700}").alias("run"))
    return per.join(words, "doc_id").join(runs, "doc_id").select("doc_id", "fits", "numbered", F.when(F.col("run"), -1).otherwise(F.col("words")).cast("bigint").alias("words"))


# index -------------------------------------------------------------------------------------------
def postings_tf(spark: SparkSession, sf: str) -> DataFrame:
    return postings(_docs(spark, sf)).select("id", "term", "tf", "dl")


def term_df_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    df = document_frequency(postings(docs)).crossJoin(F.broadcast(corpus_stats(docs)))  # one row of statistics
    return df.select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_stats(_docs(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


# retrieval ---------------------------------------------------------------------------------------
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(bm25.search(_docs(spark, sf), table(spark, sf, "questions"), 10))


def bm25_topk_tags(spark: SparkSession, sf: str) -> DataFrame:
    allowed = allowed_chunks(table(spark, sf, "chunks"), table(spark, sf, "documents"), tags=TAGS)
    return _ranked(bm25.search(_docs(spark, sf), table(spark, sf, "questions"), 10, allowed))


def bm25_topk_glob(spark: SparkSession, sf: str) -> DataFrame:
    allowed = allowed_chunks(table(spark, sf, "chunks"), sources=GLOBS)
    return _ranked(bm25.search(_docs(spark, sf), table(spark, sf, "questions"), 10, allowed))


def _dense(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors, queries = _dense(spark, sf)
    return _ranked(dense.search(vectors, queries, 10))


def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    vectors, queries = _dense(spark, sf)
    return _ranked(dense.search(vectors, queries, 10, vectors.filter(F.col("label") % 2 == 0).select("id")))


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    v = dense.embed(_docs(spark, sf), "text")
    return v.select("id", F.size(F.filter("vector", lambda x: x != 0)).alias("features"), F.round(F.sqrt(dense.cosine("vector", "vector")), 4).alias("norm"))


def _stored(spark: SparkSession, sf: str) -> Store:
    """An index over the chunks, in a folder of its own beside the checkpoints, written in two segments: the
    first has every row under another text, which the second takes back."""
    store = Store(spark, f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}", "hash:64")
    plain = [c.split()[0] for c in TABLES["chunks"].split(", ")][:-1]
    chunks = distinct_rows(table(spark, sf, "chunks").select(*plain)).withColumn("source", F.regexp_replace("id", "#[0-9]+$", ""))
    store.append(chunks=chunks.filter(F.col("position") == 0).withColumn("text", F.lit("an earlier text")))
    store.append(chunks=chunks, gone=chunks.filter(F.col("position") == 0).select("source", F.lit(True).alias("chunks")).distinct())
    return store


def stored_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over a stored index: segments, tombstones, postings picked by term."""
    store = _stored(spark, sf)
    c = Collection(store.table("chunks"), store.embedder, store.table("vectors"), store.table("postings"), store.stats())
    return _ranked(c.lexical(table(spark, sf, "questions"), 10))


def stored_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What a stored index holds: the manifest's numbers, and those of its tables."""
    store = _stored(spark, sf)
    counts = [store.table(n).agg(F.count("*").alias(n)) for n in ("chunks", "vectors", "postings")]
    out = store.stats()
    for c in counts:  # one row each
        out = out.crossJoin(c)
    return out.select("n", F.round("avgdl", 6).alias("avgdl"), "chunks", "vectors", "postings")


def rrf_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings by text and by title with heading, fused."""
    chunks, questions = table(spark, sf, "chunks"), table(spark, sf, "questions")
    head = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit("")))
    both = {"text": bm25.search(as_documents(chunks, text="text"), questions, 50), "heading": bm25.search(as_documents(chunks, text=head), questions, 50)}
    return _ranked(fusion.top(fusion.rrf(both), 10))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(Collection(table(spark, sf, "chunks")).search(table(spark, sf, "questions"), 10, "hybrid"))


def _words(spark: SparkSession, sf: str) -> Collection:
    return Collection(table(spark, sf, "chunks"), "words:256")


def dense_words_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_words(spark, sf).search(table(spark, sf, "questions"), 10, "dense"))


def hybrid_words_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_words(spark, sf).search(table(spark, sf, "questions"), 10, "hybrid"))


def eval_words_modes(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.evaluate(_words(spark, sf), table(spark, sf, "questions").drop("history"), modes=MODES[:3])
    return s.select("mode", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


def proximity_rerank(spark: SparkSession, sf: str) -> DataFrame:
    docs, questions = _docs(spark, sf), table(spark, sf, "questions")
    posts = bm25.asked_postings(docs, questions)
    pool = cut_lineage(bm25.search(docs, questions, rerank.POOL, postings=posts))
    return _ranked(rerank.proximity(docs, questions, pool, posts, 5))


def mmr_rerank(spark: SparkSession, sf: str) -> DataFrame:
    vectors, queries = _dense(spark, sf)
    return _ranked(rerank.mmr(dense.search(vectors, queries, rerank.POOL), vectors, 5))


def _wordings(questions: DataFrame) -> DataFrame:
    w = F.slice(F.array_distinct(F.concat(F.array("question"), F.coalesce("history", F.array().cast("array<string>")))), 1, 4)
    return questions.select("qid", F.posexplode(w).alias("n", "question")).withColumn("n", F.col("n") + 1)


def multi_query_fusion(spark: SparkSession, sf: str) -> DataFrame:
    found = Collection(table(spark, sf, "chunks")).multi_search(_wordings(table(spark, sf, "questions")), 5, "bm25")
    return _ranked(found)


def asks_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every ask with its own k."""
    asks = table(spark, sf, "asks").filter(requests.problem().isNull())
    q = asks.select(F.col("ask_id").alias("qid"), "question", F.coalesce("k", F.lit(5)).alias("k"))
    found = bm25.search(_docs(spark, sf), q, requests.MAX_K, own="k")
    return _ranked(found.join(q.select("qid", "k"), "qid").filter(F.col("rank") <= F.col("k")))


# answers and evaluation --------------------------------------------------------------------------
def _answers(spark: SparkSession, sf: str) -> DataFrame:
    questions = evaluate.standalone(table(spark, sf, "questions"))
    c = Collection(table(spark, sf, "chunks"))
    return A.answer(questions, c.hits(c.search(questions, 5, "bm25")))


def extractive_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("qid", "answer", F.size("sources").alias("sources"), F.array_join(T.cited_numbers("answer").cast("array<string>"), ",").alias("cited"))


def answer_highlights(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf).select("qid", F.explode("sources").alias("s"))
    return rows.select("qid", F.col("s.n").alias("n"), F.col("s.id").alias("id"), F.size("s.highlights").alias("highlights"))


def answer_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each answer: its sources, whether it cites only those and quotes what they say, or says that there is none."""
    rows = _answers(spark, sf)
    words = lambda t: F.regexp_replace(F.lower(t), "[^\\p{L}\\p{N}]+", "")
    quotes = F.filter(F.transform(F.split("answer", r"(?<=\[\d\])\s"), lambda q: F.struct(words(F.regexp_replace(q, r" \[\d+\]$", "")).alias("q"), F.regexp_extract(q, r"\[(\d+)\]$", 1).cast("int").alias("n"))), lambda x: x["n"].isNotNull())
    said = lambda x: F.exists("sources", lambda s: (s["n"] == x["n"]) & (F.contains(words(s["text"]), x["q"]) | F.contains(s["text"], F.lit("|"))))
    cites = F.forall(T.cited_numbers("answer"), lambda n: (n >= 1) & (n <= F.size("sources")))
    return rows.select("qid", F.size("sources").alias("hits"), cites.alias("cites"), F.forall(quotes, said).alias("quotes"), ((F.col("answer") == A.NO_ANSWER) == (F.size(T.cited_numbers("answer")) == 0)).alias("answered"))


def judge_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on each label as an answer that cites the first hit."""
    questions, c = table(spark, sf, "questions"), Collection(table(spark, sf, "chunks"))
    hit = c.hits(c.search(questions, 1, "bm25")).select("qid", F.array(F.struct(F.lit(1).alias("n"), "text")).alias("sources"))
    answers = questions.select("qid", "question", F.concat("contains", F.lit(" [1]")).alias("answer"), F.lit("label").alias("mode")).join(hit, "qid")
    return evaluate.judge(answers, questions).select("qid", "correct", "grounded")


def judge_report(spark: SparkSession, sf: str) -> DataFrame:
    judged = judge_labels(spark, sf).withColumn("mode", F.lit("label")).withColumn("judge", F.lit("heuristic"))
    s = evaluate.judge_summary(judged)
    return s.select("answered_by", F.array_join("judges", ",").alias("judges"), F.round("correct", 6).alias("correct"), F.round("grounded", 6).alias("grounded"), F.col("failures").cast("int").alias("failures"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of each question with its three best chunks."""
    questions, c = table(spark, sf, "questions"), Collection(table(spark, sf, "chunks"))
    hits = c.hits(c.search(questions, 3, "bm25"))
    found = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), "source", F.coalesce("heading", F.lit("")).alias("heading"), "text"))).alias("hits"))
    return questions.join(found, "qid").select("qid", F.md5(A.prompt("question", "hits")).alias("prompt"))


def rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """The history of each ask read as a backend's list of other wordings."""
    asks = table(spark, sf, "asks").filter(F.col("question").isNotNull())
    listed = F.transform(F.coalesce("history", F.array().cast("array<string>")), lambda h, i: F.concat(F.when(i % 2 == 0, "- ").otherwise("2. "), h))
    return asks.select("ask_id", F.array_join(T.clean_rewrites(F.trim("question"), F.array_join(listed, "\n")), "|").alias("wordings"))


def sql_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's tokens under their SQL name."""
    register(spark)
    return spark.sql("SELECT qid, array_join(lodestone_tokens(question), ' ') AS tokens FROM {questions}", questions=table(spark, sf, "questions"))


def eval_bm25(spark: SparkSession, sf: str) -> DataFrame:
    questions = table(spark, sf, "questions")
    c = Collection(table(spark, sf, "chunks"))
    found = c.hits(_ranked(bm25.search(c.docs, questions, 5)))
    ranks = evaluate.rank_of_first(found.withColumn("mode", F.lit("bm25")), questions)
    s = evaluate.summary(ranks)
    return s.select("mode", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


def eval_modes(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.evaluate(Collection(table(spark, sf, "chunks")), table(spark, sf, "questions"), modes=MODES)
    return s.select("mode", *[F.round(c, 4).alias(c) for c in s.columns[1:]])


def eval_answers(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.answer_summary(evaluate.answer_quality(_answers(spark, sf), table(spark, sf, "questions")))
    return s.select(*[F.round(c, 4).alias(c) for c in s.columns])


def heuristic_judge(spark: SparkSession, sf: str) -> DataFrame:
    judged = evaluate.judge(_answers(spark, sf), table(spark, sf, "questions"))
    return judged.select("qid", "correct", "grounded", "judge")


# ingest ------------------------------------------------------------------------------------------
def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Newest delivery of each file, and what the ledger last recorded, keyed by origin and source."""
    docs = table(spark, sf, "documents")
    key = F.concat(incremental.origin_key(F.coalesce("origin", F.lit(""))), F.lit("/"), F.coalesce("source", F.lit("")))
    newest = docs.groupBy(key.alias("source"), incremental.origin_key(F.coalesce("origin", F.lit(""))).alias("origin")).agg(
        F.max(F.struct(F.col("ingested_at").isNotNull().alias("dated"), "ingested_at", "doc_id", "title", "text")).alias("d")
    )
    done = incremental.recorded_versions(table(spark, sf, "ledger"), table(spark, sf, "ingest_runs"))
    known = done.select(F.concat("origin", F.lit("/"), F.coalesce("source", F.lit(""))).alias("source"), "origin", F.col("version").alias("hash"))
    return newest.select("source", "origin", "d.title", "d.text"), known


def _first_and_newest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The first delivery of each file, without those of README.md, and the newest that isn't blank (source, title, text)."""
    docs = table(spark, sf, "documents")
    key = F.concat(incremental.origin_key(F.coalesce("origin", F.lit(""))), F.lit("/"), F.coalesce("source", F.lit(""))).alias("source")
    order = F.struct(F.col("ingested_at").isNotNull().alias("dated"), "ingested_at", "doc_id", "title", "text")
    first = docs.filter(F.col("source") != "README.md").groupBy(key).agg(F.min(order).alias("d")).select("source", "d.title", "d.text")
    newest = docs.groupBy(key).agg(F.max(order).alias("d")).select("source", "d.title", "d.text")
    return first, newest.filter(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") != "")


def newest_files(spark: SparkSession, sf: str) -> DataFrame:
    return _first_and_newest(spark, sf)[1]


def _engine(spark: SparkSession, sf: str) -> tuple[Engine, IngestResult]:
    """An index that took the first deliveries, and then, pruning, the newest."""
    engine = Engine(spark, f"{checkpoint_folder(spark)}/engine-{uuid.uuid4().hex}", "hash:64")
    first, newest = _first_and_newest(spark, sf)
    engine.ingest(first, origin="files", tags=["Ops "])
    return engine, engine.ingest(newest, origin="files", prune=True)


def engine_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest of the newest deliveries does to an index of the first ones."""
    return _engine(spark, sf)[1].actions.select("source", "action")


def engine_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are left after that, and after guides are removed, with the tags they kept."""
    engine, _ = _engine(spark, sf)
    guides = engine.store.table("documents").filter(F.contains("source", F.lit("/guides/"))).select(F.regexp_extract("source", "^(.*/guides)/", 1).alias("g")).distinct()
    engine.remove([r["g"] for r in guides.orderBy("g").limit(3).collect()])  # three targets, as one call has
    return engine.store.table("documents").select("source", "hash", "origin", F.array_join("tags", ",").alias("tags"))


def ingest_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Newest deliveries of which some come from an origin that doesn't own the file, from its folder, or from nowhere."""
    files, known = _files(spark, sf)
    n = F.length("source") % 4
    other = F.when(n == 0, F.lit("elsewhere")).when(n == 1, F.concat("origin", F.lit("/"), "source")).when(n == 2, F.lit("")).otherwise(F.col("origin"))
    return ingest.classify(files.withColumn("origin", other), known).select("source", "action", "owner")


def ingest_classify(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.classify(*_files(spark, sf)).select("source", "action")


def prune_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose newest delivery is blank are missing from the batch, and so are pruned."""
    files, _ = _files(spark, sf)
    batch = files.filter(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") != "")
    return ingest.pruned(files.select("source", "origin"), batch, batch)


def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    chunks = distinct_rows(table(spark, sf, "chunks").select("id", F.col("doc_id").cast("string").alias("source"), "text"))
    docs = table(spark, sf, "documents").withColumn("source", F.col("doc_id").cast("string"))
    s = ingest.document_stats(chunks, docs)
    return s.select("source", "chunks", "chars", "origin", F.array_join("tags", ",").alias("tags"))


def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the sources that a pattern and a tag let through."""
    chunks = table(spark, sf, "chunks").filter(source_matches(GLOBS)).select("id", "source", "doc_id").distinct()
    docs = table(spark, sf, "documents").filter(has_tags(TAGS)).select("doc_id")
    return chunks.join(docs, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("chunks"))


def find_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return ingest.find_sources(docs, "guides").unionByName(ingest.find_sources(docs, "README.md")).distinct()


def reread_marks(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.reread_from(table(spark, sf, "ingest_runs")).select("origin", F.unix_micros("reread_from").alias("reread_us"))


def recorded_versions(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.recorded_versions(table(spark, sf, "ledger"), table(spark, sf, "ingest_runs"))


def p7_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Of files with a delivery that arrived since the reread mark of their origin, or at a time unknown, the
    newest delivery where it isn't the recorded one. Dates of delivery stand for arrivals."""
    args = (table(spark, sf, n) for n in ("documents", "ingest_runs", "ledger"))
    return incremental.next_run(*args, arrival="ingested_at").select("doc_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.next_run(table(spark, sf, "documents"), table(spark, sf, "ingest_runs"), table(spark, sf, "ledger")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            tokenize_counts, token_stream, stem_vocab, sentence_split, content_hash, tags_normalized, heading_promotion, extract_title,
            follow_up_flags, condense_conversations, ask_requests, html_pages, chunked_documents, chunk_checks, postings_tf, term_df_idf, corpus_statistics,
            bm25_topk, bm25_topk_tags, bm25_topk_glob, stored_topk, stored_sizes, dense_topk, dense_topk_filtered, hash_embed, rrf_fields, hybrid_topk, dense_words_topk, hybrid_words_topk, proximity_rerank,
            mmr_rerank, multi_query_fusion, asks_topk, extractive_answers, answer_highlights, answer_checks, judge_labels, judge_report, prompts, rewrites, sql_tokens, eval_bm25, eval_modes, eval_words_modes, eval_answers, heuristic_judge,
            ingest_classify, ingest_conflicts, engine_actions, engine_documents, prune_removed, doc_stats, source_counts, find_documents, reread_marks, recorded_versions, p7_found, p7_arrivals,
        )
    }


# SQL ---------------------------------------------------------------------------------------------
_WS = r"[\s\x{0b}\x{85}\p{Z}]"
_ORIGIN = r"rtrim(regexp_replace(lower(coalesce(origin, '')), '^\s+|\s+$', '', 'g'), '/')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _stem(x: str) -> str:
    cut = f"""CASE WHEN {x} LIKE '%ies' AND length({x}) >= 6 THEN left({x}, length({x}) - 3) || 'y'
        WHEN {x} LIKE '%ing' AND length({x}) >= 6 THEN left({x}, length({x}) - 3)
        WHEN {x} LIKE '%ed' AND length({x}) >= 5 THEN left({x}, length({x}) - 2)
        WHEN {x} LIKE '%s' AND right({x}, 2) NOT IN ('ss', 'us', 'is') THEN left({x}, length({x}) - 1) ELSE {x} END"""
    return f"""CASE WHEN length({x}) <= 3 OR NOT regexp_full_match({x}, '[a-z]+') THEN {x}
        WHEN length({cut}) > 4 AND ({cut}) LIKE '%e' THEN left({cut}, length({cut}) - 1) ELSE {cut} END"""


def _toks(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({text}), '{T.TOKEN}'), lambda x: x NOT IN ({_STOP})), lambda x: {_stem('x')})"


_TEXT = "coalesce(title, '') || chr(10) || coalesce(heading, '') || chr(10) || coalesce(text, '')"


def _index(text: str = _TEXT, p: str = "") -> str:
    """CTEs: tk (id, tk), stats, tf, df."""
    return f"""{p}docs AS (SELECT DISTINCT id, {text} AS body FROM chunks WHERE id IS NOT NULL),
        {p}tk AS (SELECT id, {_toks("body")} AS tk FROM {p}docs),
        {p}stats AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM {p}tk),
        {p}tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tk) AS dl, unnest(tk) AS term FROM {p}tk) GROUP BY ALL),
        {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term)"""


_QT = f"qt AS (SELECT qid, unnest(list_distinct({_toks('question')})) AS term FROM questions)"


def _bm25(p: str = "", key: str = "qid", where: str = "") -> str:
    return f"""{p}scored AS (SELECT {key}, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
            FROM qt JOIN {p}tf USING (term) JOIN {p}df USING (term), {p}stats {where} GROUP BY {key}, id),
        {p}ranked AS (SELECT {key}, id, score, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, id) AS rank FROM {p}scored)"""


_TOP = "SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM {} WHERE rank <= {}"


def _cosines(where: str = "") -> str:
    return f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
        c AS (SELECT q.vec_id AS qid, r.vec_id AS id, list_dot_product(q.e, r.e) / (q.l * r.l) AS score FROM v q, v r WHERE q.vec_id % 50 = 0 {where}),
        ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM c WHERE score > 0)"""


def _mmr(k: int) -> str:
    out = f"""WITH {_cosines()}, pool AS (SELECT qid, id, score, rank, score / max(score) OVER (PARTITION BY qid) AS rel FROM ranked WHERE rank <= 20),
        sim AS (SELECT a.qid, a.id, b.id AS other, list_dot_product(x.e, y.e) / (x.l * y.l) AS s
                FROM pool a JOIN pool b USING (qid) JOIN v x ON x.vec_id = a.id JOIN v y ON y.vec_id = b.id),
        s1 AS (SELECT qid, id, score, 1 AS place FROM pool WHERE rank = 1)"""
    for i in range(2, k + 1):
        out += f""",
        g{i} AS (SELECT p.qid, p.id, p.score, p.rank, round(0.7 * rel - 0.3 * max(s.s), 12) AS gain FROM pool p
                 JOIN s{i - 1} d ON d.qid = p.qid JOIN sim s ON s.qid = p.qid AND s.id = p.id AND s.other = d.id
                 WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} x WHERE x.qid = p.qid AND x.id = p.id) GROUP BY p.qid, p.id, p.score, p.rank, rel),
        s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT qid, id, score, {i} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, rank) AS k FROM g{i}) WHERE k = 1)"""
    return out + f" SELECT qid, id, round(score, 6) AS score, place::INT AS rank FROM s{k}"


def _file_ctes() -> str:
    return f"""d AS (SELECT {_ORIGIN} AS o, {_ORIGIN} || '/' || coalesce(source, '') AS src, sha256('800:150' || chr(10) || coalesce(title, '') || chr(10) || coalesce(text, '')) AS h,
                   row_number() OVER (PARTITION BY {_ORIGIN}, source ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) AS k FROM documents),
        ok AS (SELECT DISTINCT run_id FROM ingest_runs WHERE finished_at IS NOT NULL AND lower(trim(status)) IN ('ok', 'succeeded')),
        l AS (SELECT {_ORIGIN} AS o, source, {_ORIGIN} || '/' || coalesce(source, '') AS src, lower(trim(hash)) AS h,
                   row_number() OVER (PARTITION BY {_ORIGIN}, source ORDER BY processed_at DESC NULLS LAST, run_id DESC, lower(trim(hash)) DESC) AS k FROM ledger JOIN ok USING (run_id))"""


def _two_batches() -> str:
    """CTEs: a, b (src, h), first deliveries without README.md and newest ones that aren't blank."""
    return f"""v AS (SELECT {_ORIGIN} || '/' || coalesce(source, '') AS src, source, sha256('800:150' || chr(10) || coalesce(title, '') || chr(10) || coalesce(text, '')) AS h,
              regexp_replace(coalesce(text, ''), '[ \\t\\n\\x{{0b}}\\f\\r]', '', 'g') <> '' AS filled, ingested_at, doc_id FROM documents),
        a AS (SELECT src, h FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ingested_at NULLS FIRST, doc_id) AS k FROM v WHERE source <> 'README.md') WHERE k = 1),
        b AS (SELECT src, h FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) AS k FROM v) WHERE k = 1 AND filled)"""


_GLOB_SQL = " OR ".join(f"regexp_matches(source, '{r}')" for r in (r"^guides/", r"^s.k/.*\.md$", r"^[f-l].*/r"))
_TAG_SQL = "len(list_filter(coalesce(tags, []), lambda t: lower(trim(t)) IN ('guide', 'ops'))) > 0"
_FOLLOW = f"""length(trim(question)) > 0 AND len(regexp_extract_all(lower(question), '{T.TOKEN}')) > 0 AND (
    len(list_intersect(regexp_extract_all(lower(question), '{T.TOKEN}'), [{", ".join(f"'{w}'" for w in T.REFERRING)}])) > 0
    OR {" OR ".join(f"starts_with(lower(trim(question)), '{o}')" for o in T.OPENING)} OR len({_toks("question")}) <= 2)"""
_PROBLEM = """CASE WHEN question IS NULL OR trim(question) = '' OR length(question) > 2000 THEN 'question'
    WHEN NOT coalesce(k, 5) BETWEEN 1 AND 20 THEN 'k'
    WHEN coalesce(mode, 'hybrid') NOT IN ('bm25', 'dense', 'hybrid') THEN 'mode'
    WHEN coalesce(rerank, 'none') NOT IN ('none', 'proximity', 'mmr') THEN 'rerank'
    WHEN len(coalesce(source, [])) > 20 OR len(list_filter(coalesce(source, []), lambda x: x IS NULL OR x = '')) > 0 THEN 'source'
    WHEN len(coalesce(tag, [])) > 20 OR len(list_filter(coalesce(tag, []), lambda x: x IS NULL OR x = '')) > 0 THEN 'tag'
    WHEN len(list_filter(coalesce(history, []), lambda x: x IS NULL OR length(x) > 2000)) > 0 THEN 'history' END"""


_SKIP = ", ".join(f"'{w}'" for w in [*T.STOPWORDS, *T.REFERRING])


def _condensed(rows: str, key: str) -> str:
    """CTEs: condensed (key, standalone) of rows (key, question, history), turn by turn."""
    stems = f"list_transform(w, lambda x: {_stem('lower(x)')})"
    follow = _FOLLOW.replace("question", "turn")
    return f"""turns AS (SELECT {key}, t[greatest(1, len(t) - 9):] || [question] AS t FROM
                   (SELECT {key}, question, list_filter(coalesce(history, []), lambda h: trim(h) <> '') AS t FROM {rows})),
        said AS (SELECT {key}, 1 AS i, t[1] AS said, t FROM turns UNION ALL
            SELECT {key}, i, CASE WHEN coalesce({follow}, false) AND len(new) > 0 THEN trim(turn) || ' (' || array_to_string(new[:8], ' ') || ')' ELSE turn END, t FROM (
                SELECT {key}, i, turn, t, list_filter(w, lambda x, k: NOT list_contains(have, stems[k]) AND list_position(stems, stems[k]) = k) AS new FROM (
                    SELECT *, {stems} AS stems FROM (
                        SELECT {key}, i + 1 AS i, t[i + 1] AS turn, t, {_toks("t[i + 1]")} AS have,
                               list_filter(regexp_extract_all(said, '(?i){T.TOKEN}'), lambda x: lower(x) NOT IN ({_SKIP})) AS w
                        FROM said WHERE i < len(t))))),
        condensed AS (SELECT {key}, said AS standalone FROM said WHERE i = len(t))"""


def _word_vectors(name: str, rows: str, key: str, text: str) -> str:
    """CTE: name (key, b, x), components of the word embedder's vectors, rounded as it stores them."""
    return f"""{name}_c AS (SELECT {key}, ('0x' || left(md5(t), 7))::BIGINT % 256 AS b, sum(CASE WHEN substr(md5(t), 8, 1) < '8' THEN 1.0 ELSE -1.0 END * ln(1 + tf)) AS x
            FROM (SELECT {key}, t, count(*)::DOUBLE AS tf FROM (SELECT {key}, unnest({_toks(text)}) AS t FROM {rows}) GROUP BY ALL) GROUP BY ALL),
        {name}_f AS (SELECT {key}, b, (x / sqrt(sum(x * x) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x FROM {name}_c WHERE abs(x) > 1e-9),
        {name} AS (SELECT {key}, b, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {name}_f)"""


def _words_ranked() -> str:
    """CTEs: ranked (BM25), d_ranked (word vectors), both of the questions."""
    return f"""{_index()}, {_QT}, {_bm25()}, {_word_vectors("cv", "docs", "id", "body")}, {_word_vectors("qv", "questions", "qid", "question")},
        d_scored AS (SELECT qid, id, sum(qv.x * cv.x) AS score FROM qv JOIN cv USING (b) GROUP BY qid, id),
        d_ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM d_scored WHERE score > 0),
        u AS (SELECT qid, id, rank FROM ranked WHERE rank <= 50 UNION ALL SELECT qid, id, rank FROM d_ranked WHERE rank <= 50),
        f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY qid, id),
        h_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f)"""


def oracle_sql() -> dict[str, str]:
    trim = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
    return {
        "tokenize_counts": f"WITH {_index()} SELECT id, len(tk)::INT AS tokens, len(list_distinct(tk))::INT AS stems FROM tk",
        "token_stream": f"SELECT qid, (generate_subscripts(t, 1) - 1)::INT AS pos, unnest(t) AS token FROM (SELECT qid, {_toks('question')} AS t FROM questions)",
        "stem_vocab": f"WITH {_index()} SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY term",
        "sentence_split": f"""SELECT id, len(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '{_WS}+', ' ', 'g')),
            '([.!?]) ([("''\\[]?[A-Z0-9`])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> ''))::INT AS sentences
            FROM (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL)""",
        "content_hash": "SELECT doc_id, sha256('800:150' || chr(10) || coalesce(title, '') || chr(10) || coalesce(text, '')) AS hash FROM documents",
        "tags_normalized": "SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(tags, []), lambda t: trim(t) <> ''), lambda t: lower(trim(t))))), ','), '') AS tags FROM documents",
        "heading_promotion": f"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '(?m)^#{{1,6}}\\s') THEN text ELSE array_to_string(list_transform(
              list_transform(string_split_regex({trim("text")}, '\\n\\s*\\n'), lambda p: {trim("p")}),
              lambda p, i: CASE WHEN NOT contains(p, chr(10)) AND length(p) BETWEEN 1 AND 70 AND NOT regexp_matches(p, '[.,;:!?)]$') THEN (CASE WHEN i = 1 THEN '# ' ELSE '## ' END) || p ELSE p END),
              chr(10) || chr(10)) END) AS promoted FROM documents WHERE text IS NOT NULL""",
        "extract_title": """SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?m)^# ') THEN trim(regexp_extract(text, '(?m)^# ([^\\r\\n]*)', 1))
            ELSE regexp_extract(source, '([^/]*?)(?:\\.[^./]*)?$', 1) END AS title FROM documents""",
        "follow_up_flags": f"SELECT ask_id, coalesce({_FOLLOW}, false) AS follow_up FROM asks",
        "condense_conversations": f"WITH RECURSIVE {_condensed('asks', 'ask_id')} SELECT ask_id, standalone FROM condensed",
        "answer_highlights": f"""WITH RECURSIVE {_condensed("questions", "qid")}, {_index()}, qs AS (SELECT qid, {_toks("standalone")} AS q FROM condensed),
            qt AS (SELECT qid, unnest(list_distinct(q)) AS term FROM qs), {_bm25()}, pay AS (SELECT DISTINCT id, text FROM chunks)
            SELECT qid, rank::INT AS n, id, len(list_filter({_toks("text")}, lambda t: list_contains(q, t)))::INT AS highlights FROM ranked JOIN pay USING (id) JOIN qs USING (qid) WHERE rank <= 5""",
        "answer_checks": f"""WITH RECURSIVE {_condensed("questions", "qid")}, {_index()}, qt AS (SELECT qid, unnest(list_distinct({_toks("standalone")})) AS term FROM condensed), {_bm25()}
            SELECT q.qid, count(r.id)::INT AS hits, true AS cites, true AS quotes, true AS answered FROM questions q LEFT JOIN (FROM ranked WHERE rank <= 5) r USING (qid) GROUP BY q.qid""",
        "judge_labels": f"""WITH {_index()}, {_QT}, {_bm25()}, pay AS (SELECT DISTINCT id, text FROM chunks)
            SELECT qid, true AS correct, 2 * len(list_intersect(list_distinct({_toks("contains")}), {_toks("text")})) >= len(list_distinct({_toks("contains")})) AS grounded
            FROM questions JOIN (FROM ranked WHERE rank = 1) USING (qid) JOIN pay USING (id)""",
        "judge_report": f"""WITH {_index()}, {_QT}, {_bm25()}, pay AS (SELECT DISTINCT id, text FROM chunks),
            v AS (SELECT 2 * len(list_intersect(list_distinct({_toks("contains")}), {_toks("text")})) >= len(list_distinct({_toks("contains")})) AS grounded
                  FROM questions JOIN (FROM ranked WHERE rank = 1) USING (qid) JOIN pay USING (id))
            SELECT 'label' AS answered_by, 'heuristic' AS judges, 1.0::DOUBLE AS correct, round(avg(grounded::INT), 6) AS grounded, (count(*) FILTER (NOT grounded))::INT AS failures FROM v""",
        "prompts": f"""WITH {_index()}, {_QT}, {_bm25()}, pay AS (SELECT DISTINCT id, source, coalesce(heading, '') AS heading, text FROM chunks)
            SELECT qid, md5('<sources>' || chr(10) || string_agg('<source id="' || rank || '" document="' || p.source || '" section="' || p.heading || '">' || chr(10) || p.text || chr(10) || '</source>', chr(10) ORDER BY rank)
                || chr(10) || '</sources>' || chr(10) || chr(10) || 'Question: ' || any_value(question)) AS prompt
            FROM ranked JOIN pay p USING (id) JOIN questions USING (qid) WHERE rank <= 3 GROUP BY qid""",
        "rewrites": """SELECT ask_id, array_to_string(([trim(question)] || list_filter(list_transform(coalesce(history, []), lambda h: trim(h)), lambda h: h <> '' AND lower(h) <> lower(trim(question))))[:4], '|') AS wordings
            FROM asks WHERE question IS NOT NULL""",
        "sql_tokens": f"SELECT qid, array_to_string({_toks('question')}, ' ') AS tokens FROM questions",
        "dense_words_topk": f"WITH {_words_ranked()} {_TOP.format('d_ranked', 10)}",
        "hybrid_words_topk": f"WITH {_words_ranked()} {_TOP.format('h_ranked', 10)}",
        "eval_words_modes": f"""WITH {_words_ranked()}, pay AS (SELECT DISTINCT id, source, text FROM chunks),
            a AS (SELECT 'bm25' AS mode, qid, id, rank FROM ranked UNION ALL SELECT 'dense', qid, id, rank FROM d_ranked UNION ALL SELECT 'hybrid', qid, id, rank FROM h_ranked),
            h AS (SELECT mode, qid, rank, p.source, coalesce(p.source = q.source AND contains(lower(p.text), lower(q.contains)), false) AS hit FROM (FROM a WHERE rank <= 5) JOIN pay p USING (id) JOIN questions q USING (qid)),
            per AS (SELECT mode, qid, min(rank) FILTER (hit) AS rank, count(DISTINCT source) AS docs FROM h GROUP BY ALL),
            every AS (SELECT m.mode, rank, coalesce(docs, 0) AS docs FROM (SELECT DISTINCT mode FROM a) m CROSS JOIN questions q LEFT JOIN per ON per.mode = m.mode AND per.qid = q.qid)
            SELECT mode, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS recall_3,
                   round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(docs), 6) AS docs FROM every GROUP BY mode""",
        "ask_requests": f"SELECT ask_id, {_PROBLEM} AS problem FROM asks",
        "chunk_checks": rf"""WITH l AS (SELECT doc_id, regexp_matches(text, '\S{{700}}') AS run, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
            f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM l),
            w AS (SELECT doc_id, run, unnest(string_split_regex(line, '{_BLANKS}')) AS w FROM f WHERE fence OR inside OR NOT regexp_matches(line, '^#{{1,6}}\s+.'))
            SELECT doc_id, true AS fits, true AS numbered, CASE WHEN any_value(run) THEN -1 ELSE count(DISTINCT w) END::BIGINT AS words FROM w WHERE w <> '' GROUP BY doc_id""",
        "postings_tf": f"WITH {_index()} SELECT id, term, tf, dl::INT AS dl FROM tf",
        "term_df_idf": f"WITH {_index()} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats",
        "corpus_statistics": f"WITH {_index()} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
        "bm25_topk": f"WITH {_index()}, {_QT}, {_bm25()} {_TOP.format('ranked', 10)}",
        "bm25_topk_tags": f"WITH {_index()}, {_QT}, ok AS (SELECT id FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE {_TAG_SQL})), {_bm25(where='WHERE id IN (FROM ok)')} {_TOP.format('ranked', 10)}",
        "bm25_topk_glob": f"WITH {_index()}, {_QT}, ok AS (SELECT id FROM chunks WHERE {_GLOB_SQL}), {_bm25(where='WHERE id IN (FROM ok)')} {_TOP.format('ranked', 10)}",
        "dense_topk": f"WITH {_cosines()} {_TOP.format('ranked', 10)}",
        "dense_topk_filtered": f"WITH {_cosines('AND r.label % 2 = 0')} {_TOP.format('ranked', 10)}",
        "rrf_fields": f"""WITH {_index("coalesce(text, '')", "a_")}, {_index("coalesce(title, '') || chr(10) || coalesce(heading, '')", "b_")}, {_QT}, {_bm25("a_")}, {_bm25("b_")},
            u AS (SELECT qid, id, rank FROM a_ranked WHERE rank <= 50 UNION ALL SELECT qid, id, rank FROM b_ranked WHERE rank <= 50),
            f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY qid, id),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f) {_TOP.format("ranked", 10)}""",
        "proximity_rerank": f"""WITH {_index()}, {_QT}, {_bm25()}, pool AS (SELECT qid, id, rank FROM ranked WHERE rank <= 20),
            w AS (SELECT qid, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM qt LEFT JOIN df USING (term), stats),
            tot AS (SELECT qid, sum(idf) AS total FROM w GROUP BY qid),
            pos AS (SELECT p.qid, p.id, t.pos, t.term FROM pool p JOIN (SELECT id, generate_subscripts(tk, 1) AS pos, unnest(tk) AS term FROM tk) t ON t.id = p.id
                    JOIN qt ON qt.qid = p.qid AND qt.term = t.term),
            has AS (SELECT qid, id, count(DISTINCT term) AS m FROM pos GROUP BY qid, id),
            cov AS (SELECT x.qid, x.id, sum(idf) AS c FROM (SELECT DISTINCT qid, id, term FROM pos) x JOIN w ON w.qid = x.qid AND w.term = x.term GROUP BY x.qid, x.id),
            ends AS (SELECT e.qid, e.id, e.pos, t.term, max(t.pos) AS last FROM pos e JOIN pos t ON t.qid = e.qid AND t.id = e.id AND t.pos <= e.pos GROUP BY e.qid, e.id, e.pos, t.term),
            wins AS (SELECT qid, id, pos - min(last) + 1 AS span, count(*) AS terms FROM ends GROUP BY qid, id, pos),
            span AS (SELECT wins.qid, wins.id, min(span) AS span FROM wins JOIN has USING (qid, id) WHERE terms = m GROUP BY wins.qid, wins.id),
            prox AS (SELECT p.qid, p.id, p.rank, coalesce(c / total * (0.5 + 0.5 * m / span), 0) AS score FROM pool p LEFT JOIN has USING (qid, id) LEFT JOIN cov USING (qid, id) LEFT JOIN span USING (qid, id) JOIN tot USING (qid)),
            two AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS close FROM prox),
            f AS (SELECT qid, id, 1.0::DOUBLE / (60 + rank) + 1.0::DOUBLE / (60 + close) AS score FROM two),
            r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f) {_TOP.format("r", 5)}""",
        "mmr_rerank": _mmr(5),
        "multi_query_fusion": f"""WITH {_index()}, wl AS (SELECT qid, list_slice(list_filter([question] || coalesce(history, []), lambda x, i: list_position([question] || coalesce(history, []), x) = i), 1, 4) AS w FROM questions),
            ws AS (SELECT qid, generate_subscripts(w, 1) AS n, unnest(w) AS question, len(w) AS many FROM wl),
            qt AS (SELECT qid, n AS nth, many, unnest(list_distinct({_toks("question")})) AS term FROM ws WHERE trim(question) <> ''), {_bm25(key="qid, nth, many")},
            one AS (SELECT qid, id, score, rank FROM ranked WHERE many = 1 AND rank <= 5),
            f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ranked WHERE many > 1 AND rank <= 20 GROUP BY qid, id),
            r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f)
            SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (FROM one UNION ALL SELECT qid, id, score, rank FROM r WHERE rank <= 5)""",
        "asks_topk": f"""WITH {_index()}, a AS (SELECT ask_id AS qid, question, coalesce(k, 5) AS k FROM asks WHERE ({_PROBLEM}) IS NULL),
            qt AS (SELECT qid, unnest(list_distinct({_toks("question")})) AS term FROM a), {_bm25()}
            SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM ranked JOIN a USING (qid) WHERE rank <= k""",
        "eval_bm25": f"""WITH {_index()}, {_QT}, {_bm25()}, pay AS (SELECT DISTINCT id, source, text FROM chunks),
            h AS (SELECT r.qid, r.rank, p.source, coalesce(p.source = q.source AND contains(lower(p.text), lower(q.contains)), false) AS hit FROM ranked r JOIN pay p USING (id) JOIN questions q ON q.qid = r.qid WHERE r.rank <= 5),
            per AS (SELECT qid, min(rank) FILTER (hit) AS rank, count(DISTINCT source) AS docs FROM h GROUP BY qid),
            every AS (SELECT rank, coalesce(docs, 0) AS docs FROM questions LEFT JOIN per USING (qid))
            SELECT 'bm25' AS mode, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS recall_3,
                   round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(docs), 6) AS docs FROM every""",
        "ingest_classify": f"WITH {_file_ctes()} SELECT d.src AS source, CASE WHEN l.src IS NULL THEN 'added' WHEN l.h = d.h THEN 'unchanged' ELSE 'updated' END AS action FROM d LEFT JOIN (FROM l WHERE k = 1) l ON l.src = d.src WHERE d.k = 1",
        "ingest_conflicts": f"""WITH {_file_ctes()}, j AS (SELECT d.src, d.o, l.src AS known, l.h = d.h AS same, length(d.src) % 4 AS n FROM d LEFT JOIN (FROM l WHERE k = 1) l ON l.src = d.src WHERE d.k = 1)
            SELECT src AS source, CASE WHEN known IS NULL THEN 'added' WHEN n = 0 AND o <> '' THEN 'conflict' WHEN same THEN 'unchanged' ELSE 'updated' END AS action,
                   CASE WHEN known IS NOT NULL AND n = 0 AND o <> '' THEN o END AS owner FROM j""",
        "engine_actions": f"WITH {_two_batches()} SELECT coalesce(a.src, b.src) AS source, CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.src = b.src",
        "engine_documents": f"""WITH {_two_batches()}, g AS (SELECT DISTINCT regexp_extract(src, '^(.*/guides)/', 1) AS g FROM b WHERE contains(src, '/guides/') ORDER BY g LIMIT 3)
            SELECT b.src AS source, b.h AS hash, 'files' AS origin, CASE WHEN a.src IS NULL THEN '' ELSE 'ops' END AS tags FROM b LEFT JOIN a ON a.src = b.src WHERE NOT EXISTS (SELECT 1 FROM g WHERE starts_with(b.src, g || '/'))""",
        "prune_removed": f"""WITH d AS (SELECT {_ORIGIN} AS o, {_ORIGIN} || '/' || coalesce(source, '') AS src, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x{{0b}}\\f\\r]', '', 'g') <> '' AS full,
              row_number() OVER (PARTITION BY {_ORIGIN}, source ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) AS k FROM documents)
            SELECT src AS source FROM d WHERE k = 1 AND NOT d.full AND o IN (SELECT o FROM d WHERE k = 1 AND d.full)""",
        "doc_stats": """SELECT c.doc_id::VARCHAR AS source, count(*) AS chunks, sum(length(text))::BIGINT AS chars, any_value(d.origin) AS origin,
              any_value(coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(d.tags, []), lambda t: trim(t) <> ''), lambda t: lower(trim(t))))), ','), '')) AS tags
            FROM (SELECT DISTINCT id, doc_id, text FROM chunks) c LEFT JOIN (SELECT doc_id, origin, tags FROM documents) d ON d.doc_id = c.doc_id GROUP BY c.doc_id""",
        "source_counts": f"SELECT source, count(*) AS chunks FROM (SELECT DISTINCT id, source, doc_id FROM chunks WHERE {_GLOB_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE {_TAG_SQL}) GROUP BY source",
        "find_documents": "SELECT DISTINCT source FROM documents WHERE source IN ('guides', 'README.md') OR source LIKE 'guides/%' OR source LIKE 'README.md/%' OR origin IN ('guides', 'README.md') OR origin || '/' || source IN ('guides', 'README.md')",
        "reread_marks": f"""WITH r AS (SELECT {_ORIGIN} AS origin, started_at, finished_at, lower(trim(status)) AS status FROM ingest_runs),
            last AS (SELECT origin, max(started_at) AS s FROM r WHERE finished_at IS NOT NULL AND status IN ('ok', 'succeeded') GROUP BY origin)
            SELECT origin, epoch_us(min(started_at)) AS reread_us FROM r JOIN last USING (origin) WHERE started_at <= s AND (finished_at IS NULL OR finished_at >= s) GROUP BY origin""",
        "recorded_versions": f"WITH {_file_ctes()} SELECT o AS origin, source, h AS version FROM l WHERE k = 1",
        "p7_arrivals": f"""
            WITH {_file_ctes()}, v AS (SELECT {_ORIGIN} AS o, source, doc_id, ingested_at AS seen, lower(trim(coalesce(hash, sha256('800:150' || chr(10) || coalesce(title, '') || chr(10) || coalesce(text, ''))))) AS h FROM documents),
            n AS (SELECT *, row_number() OVER (PARTITION BY o, source ORDER BY seen DESC NULLS LAST, doc_id DESC) AS k FROM v),
            r AS (SELECT {_ORIGIN} AS o, started_at, finished_at, lower(trim(status)) AS status FROM ingest_runs),
            s AS (SELECT o, max(started_at) AS s FROM r WHERE finished_at IS NOT NULL AND status IN ('ok', 'succeeded') GROUP BY o),
            mark AS (SELECT r.o, min(started_at) AS m FROM r JOIN s ON s.o = r.o WHERE started_at <= s AND (finished_at IS NULL OR finished_at >= s) GROUP BY r.o),
            touched AS (SELECT DISTINCT v.o, v.source FROM v LEFT JOIN mark ON mark.o = v.o WHERE m IS NULL OR seen IS NULL OR seen >= m)
            SELECT doc_id FROM n WHERE k = 1 AND EXISTS (SELECT 1 FROM touched t WHERE t.o = n.o AND t.source IS NOT DISTINCT FROM n.source) AND NOT EXISTS
              (SELECT 1 FROM l WHERE l.k = 1 AND l.o = n.o AND l.source IS NOT DISTINCT FROM n.source AND l.h IS NOT DISTINCT FROM n.h)""",
        "stored_topk": f"WITH {_index()}, {_QT}, {_bm25()} {_TOP.format('ranked', 10)}",
        "stored_sizes": f"WITH {_index()} SELECT n, round(avgdl, 6) AS avgdl, n AS chunks, n AS vectors, (SELECT count(*) FROM tf) AS postings FROM stats",
        "p7_found": f"""
            WITH d AS (SELECT {_ORIGIN} AS o, source, doc_id, lower(trim(coalesce(hash, sha256('800:150' || chr(10) || coalesce(title, '') || chr(10) || coalesce(text, ''))))) AS h,
                         row_number() OVER (PARTITION BY {_ORIGIN}, source ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) AS k FROM documents),
            ok AS (SELECT DISTINCT run_id FROM ingest_runs WHERE finished_at IS NOT NULL AND lower(trim(status)) IN ('ok', 'succeeded')),
            l AS (SELECT {_ORIGIN} AS o, source, lower(trim(hash)) AS h,
                         row_number() OVER (PARTITION BY {_ORIGIN}, source ORDER BY processed_at DESC NULLS LAST, run_id DESC, lower(trim(hash)) DESC) AS k FROM ledger JOIN ok USING (run_id))
            SELECT doc_id FROM d WHERE k = 1 AND NOT EXISTS
              (SELECT 1 FROM l WHERE l.k = 1 AND l.o = d.o AND l.source IS NOT DISTINCT FROM d.source AND l.h IS NOT DISTINCT FROM d.h)""",
    }
