"""BM25 ranking of many questions in one job.

Statistics (n, df, avgdl) always cover the whole collection; ``allowed`` filters candidates before the
rank cut. Each question's terms count once. Questions without terms and terms without postings give
nothing. Ties, after rounding scores to nine places, go to the smaller id.

One pass over the texts leaves the asked terms of each record, one row a record; from stored postings
the same rows come by picking the asked terms, which the postings' order by term lets the scan skip to,
and bringing them together by record. A second pass over these rows inverts a block of records, adds up
the postings of each question's terms and keeps the best k of each question over all blocks of the task,
so that what is sorted and shuffled is at most k rows per question and task, whatever the number of
questions or records. Questions of the same terms are scored once. Only if more different terms are
asked for than may be sent to the tasks, postings are joined to the questions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.dense import tokens
from lodestone.operators.index import RECORDS, TOKENS, batch_totals, corpus_stats, document_frequency, idf, record_counts, small, term_counts
from lodestone.session import cut_lineage

K1, B = 1.5, 0.75
#: Terms, and (question, term) pairs, sent to the tasks at once. Of more pairs the questions are scored in
#: parts; of more terms, postings are joined to the questions.
PAIRS = 2_000_000
#: Terms that are named in a filter of the postings' scan; of more they are joined.
NAMED = 500
#: A task's block of records ends beyond so many records or postings; the first one, of ``FIRST``, tells which
#: scores a further record must reach.
FIRST, BLOCK, CELLS = 2_048, 65_536, 4_000_000
#: Frequent terms whose share in the score is held for every record of a block.
WHOLE = 128
#: More than sums of the same parts in another order, or rounding to nine places, can make a score differ.
EDGE = 1e-8
#: Rows that a task keeps for all questions together; for more the questions are scored in parts.
KEPT = 1_000_000


def query_terms(questions: DataFrame, keep: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``<keep>, term``: the different terms of each question, by Arrow batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            terms = [list(dict.fromkeys(tokens(q or ""))) for q in b[len(keep)].to_pylist()]
            row = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, terms))))
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns[: len(keep)]), pa.array([t for some in terms for t in some], pa.string())], [*keep, "term"])

    schema = ", ".join([*(f"`{c}` {questions.schema[c].dataType.simpleString()}" for c in keep), "term string"])
    return questions.select(*keep, "question").mapInArrow(run, schema)


@dataclass
class Postings:
    """Postings of asked terms, with the statistics of the whole collection.

    ``records`` (id, dl, terms, tfs) has a row per record with an asked term; ``df`` says in how many records
    each term is, ``asked`` holds the questions' (qid, term) pairs. Of more terms than may be sent to the
    tasks there are ``postings`` (id, dl, term, tf) and frames of statistics instead."""

    n: int = 0
    avgdl: float = 0.0
    df: dict[str, int] = field(default_factory=dict)
    records: DataFrame | None = None
    questions: DataFrame | None = None
    asked: pa.Table | None = None
    postings: DataFrame | None = None
    frames: tuple[DataFrame, DataFrame] | None = None  # (n, avgdl), (term, df)

    def idf(self, term: str) -> float:
        d = self.df.get(term, 0)
        return float(np.log(1 + (self.n - d + 0.5) / (d + 0.5)))

    def asked_by(self, questions: DataFrame, own: str | None = None) -> pa.Table | None:
        """The questions' pairs, or None if there are too many."""
        return self.asked if questions is self.questions and own is None else _pairs(questions, own)

    def weighted_terms(self, questions: DataFrame) -> DataFrame:
        """``qid, names, idfs``: each question's terms and their weights, those that no record has included."""
        pairs = self.asked_by(questions) if self.frames is None else None
        if pairs is not None:
            terms = pairs["term"].to_pylist()
            weight = {t: self.idf(t) for t in set(terms)}
            table = pa.table({"qid": pairs["qid"], "names": pairs["term"], "idfs": pa.array([weight[t] for t in terms], pa.float64())})
            return questions.sparkSession.createDataFrame(table.group_by("qid").aggregate([("names", "list"), ("idfs", "list")]).rename_columns(["qid", "names", "idfs"]))
        stats, df = self.frames or (None, None)
        if stats is None or df is None:
            spark = questions.sparkSession
            stats, df = spark.createDataFrame([(self.n,)], "n bigint"), spark.createDataFrame(list(self.df.items()), "term string, df bigint")
        terms = query_terms(questions).join(df, "term", "left").crossJoin(F.broadcast(stats.select("n")))  # one row
        t = F.collect_list(F.struct("term", idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))).alias("t")  # a question's own terms
        return terms.groupBy("qid").agg(t).select("qid", F.col("t.term").alias("names"), F.col("t.idf").alias("idfs"))


def _pairs(questions: DataFrame, own: str | None = None) -> pa.Table | None:
    """The (qid, term) pairs of the questions, or None if there are more than ``PAIRS``."""
    table = query_terms(questions, ("qid", *([own] if own else []))).limit(PAIRS + 1).toArrow()
    return table if table.num_rows <= PAIRS else None


def _names(questions: DataFrame, pairs: pa.Table | None) -> list[str] | None:
    """The terms asked for, or None if there are more than ``PAIRS``."""
    if pairs is not None:
        return pc.unique(pairs["term"]).to_pylist()
    names = [r["term"] for r in query_terms(questions, ()).distinct().limit(PAIRS + 1).collect()]
    return names if len(names) <= PAIRS else None


def asked_postings(docs: DataFrame, questions: DataFrame) -> Postings:
    """Postings of the questions' terms from the texts, written once."""
    pairs = _pairs(questions)
    names = _names(questions, pairs)
    if names is None:
        tf = term_counts(docs).filter(F.col("term") != "").join(query_terms(questions, ()).distinct(), "term", "left_semi")
        return Postings(postings=tf, frames=(corpus_stats(docs), document_frequency(tf)))
    rows = cut_lineage(record_counts(docs, names))
    totals = {r["term"]: r["total"] for r in batch_totals(rows).collect()}  # asked terms only
    n, tokens = totals.pop(RECORDS, 0), totals.pop(TOKENS, 0)
    return Postings(n, tokens / n if n else 0.0, totals, rows.filter(F.col("id").isNotNull()), questions, pairs)


def stored_postings(tf: DataFrame, stats: DataFrame, questions: DataFrame) -> Postings:
    """Postings of the questions' terms from stored ones (id, dl, term, tf), written once.

    A record's list holds the asked terms it has, so it is no longer than the text."""
    pairs = _pairs(questions)
    names = _names(questions, pairs)
    terms = query_terms(questions, ()).distinct()
    if names is None:
        some = tf.join(terms, "term", "left_semi")
        return Postings(postings=some, frames=(stats, document_frequency(some)))
    some = tf.filter(F.col("term").isin(names)) if len(names) <= NAMED else tf.join(F.broadcast(terms), "term", "left_semi")
    by_record = some.groupBy("id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("c"))
    records = cut_lineage(by_record.select("id", "dl", F.col("c.term").alias("terms"), F.col("c.tf").alias("tfs")))
    row = stats.first()
    counted = records.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # asked terms only
    return Postings(row["n"], row["avgdl"], {r["term"]: r["df"] for r in counted}, records, questions, pairs)


def _score_records(p: Postings, questions: DataFrame, k: int, allowed: DataFrame | None, own: str | None) -> DataFrame:
    """``qid, id, score, rank``."""
    asked = p.asked_by(questions, own)
    if asked is not None:
        return _score_part(p, questions, asked, k, allowed, own)
    pairs = query_terms(questions, ("qid", *([own] if own else [])))
    parts = -(-2 * pairs.count() // PAIRS)
    some = [pairs.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == x).toArrow() for x in range(parts)]
    return reduce(DataFrame.unionByName, [_score_part(p, questions, t, k, allowed, own) for t in some])


def _score_part(p: Postings, questions: DataFrame, asked: pa.Table, k: int, allowed: DataFrame | None, own: str | None) -> DataFrame:
    qids = asked["qid"].combine_chunks().dictionary_encode()
    q = np.asarray(qids.indices.to_numpy(zero_copy_only=False))
    most = np.full(len(qids.dictionary), 0 if own else k, np.int64)  # rows wanted of each question
    if own:
        np.maximum.at(most, q, np.clip(np.asarray(pc.fill_null(asked[own].cast(pa.int64()), k).to_numpy()), 0, k))
    order = sorted(p.df)
    at = {t: i for i, t in enumerate(order)}
    term = np.array([at.get(t, -1) for t in asked["term"].to_pylist()], np.int64)
    q, term = q[term >= 0], term[term >= 0]
    by = np.lexsort((term, q))
    q, term = q[by], term[by]
    edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
    same: dict[bytes, list[int]] = {}
    for lo, hi in zip(edges, edges[1:]):
        same.setdefault(term[lo:hi].tobytes(), []).append(int(q[lo]))
    wanted = [(np.frombuffer(t, np.int64), int(most[some].max()), some) for t, some in same.items()]
    part = np.cumsum([n for _, n, _ in wanted], dtype=np.int64) // KEPT
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(wanted)]
    weight = np.array([p.idf(t) for t in order])
    rows = p.records if allowed is None else p.records.join(allowed, "id", "left_semi")
    kind = questions.schema["qid"].dataType.simpleString()
    found = [_rank(rows, wanted[x:y], at, weight, p.avgdl or 1.0, k, qids.dictionary, most, kind) for x, y in zip(cuts, cuts[1:])]
    return reduce(DataFrame.unionByName, found)


def _rank(rows: DataFrame, wanted: list[tuple[np.ndarray, int, list[int]]], at: dict[str, int], weight: np.ndarray, avgdl: float, k: int, names: pa.Array, most: np.ndarray, kind: str) -> DataFrame:
    """``qid, id, score, rank`` of questions by their terms: (terms, rows wanted, numbers of the questions with these terms)."""
    terms, first = np.concatenate([np.zeros(0, np.int64), *(t for t, _, _ in wanted)]), np.cumsum([0, *(len(t) for t, _, _ in wanted)])
    who, start = np.array([x for _, _, some in wanted for x in some], np.int64), np.cumsum([0, *(len(some) for _, _, some in wanted)])
    scoring = rows.sparkSession.sparkContext.broadcast((at, weight, terms, first, np.array([n for _, n, _ in wanted], np.int64)))
    asking = rows.sparkSession.sparkContext.broadcast((names, who, start, most))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, weight, terms, first, size = scoring.value
        best = _Best(size)
        for block in _blocks(batches):
            _score_block(block, at, weight, avgdl, terms, first, best)
        yield from best.batches()

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        names, who, start, most = asking.value
        for b in batches:
            of, rank = (np.asarray(b[c].to_numpy(zero_copy_only=False)) for c in (0, 3))
            n = start[of + 1] - start[of]
            row = np.repeat(np.arange(b.num_rows), n)
            x = who[np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            x, row = x[keep := rank[row] <= most[x]], row[keep]
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), *(b[c].take(row) for c in (1, 2, 3))], ["qid", "id", "score", "rank"])

    id = rows.schema["id"].dataType.simpleString()
    ranked = top(rows.mapInArrow(score, f"qid int, id {id}, score double"), k)
    return ranked.mapInArrow(ask, f"qid {kind}, id {id}, score double, rank int")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterable[list[pa.RecordBatch]]:
    some: list[pa.RecordBatch] = []
    records = postings = 0
    begun = False
    for b in batches:
        if not begun and b.num_rows > FIRST:
            yield [b.slice(0, FIRST)]
            b = b.slice(FIRST)
        begun = True
        some.append(b)
        records, postings = records + b.num_rows, postings + len(b[2].flatten())
        if records >= BLOCK or postings >= CELLS:
            yield some
            some, records, postings = [], 0, 0
    if records:
        yield some


class _Best:
    """The best rows of each question over the blocks so far; ``low`` is the rounded score that a further row must reach."""

    def __init__(self, size: np.ndarray):
        self.size, self.low = size, np.full(len(size), -np.inf)
        self.q, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.ids: pa.Array | None = None

    def add(self, ids: pa.Array, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        used, row = np.unique(row, return_inverse=True)
        ids = ids.take(pa.array(used))
        if self.ids is not None:
            row, ids = row + len(self.ids), pa.concat_arrays([self.ids, ids])
        q, row, score = (np.concatenate(x) for x in ((self.q, q), (self.row, row), (self.score, score)))
        place = np.empty(len(ids), np.int64)
        place[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
        rounded = np.round(score, 9)
        by = np.lexsort((place[row], -rounded, q))
        q = q[by]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.size[q] - 1
        self.low[q[last]] = rounded[by][last]
        keep = nth < self.size[q]
        self.q, self.score = q[keep], score[by][keep]
        used, self.row = np.unique(row[by][keep], return_inverse=True)
        self.ids = ids.take(pa.array(used))

    def batches(self) -> Iterable[pa.RecordBatch]:
        for x in range(0, len(self.q), 50_000):
            part = slice(x, x + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.q[part], pa.int32()), self.ids.take(pa.array(self.row[part])), pa.array(self.score[part])], ["qid", "id", "score"])


def _score_block(block: list[pa.RecordBatch], at: dict[str, int], weight: np.ndarray, avgdl: float, terms: np.ndarray, first: np.ndarray, best: _Best) -> None:
    """Adds the best records of the block; they are numbered in the order of their ids, which settles ties.

    A question's weakest terms that together add less than ``low`` (by the most that each adds in the block) can't
    bring a record in by themselves: only records with another of its terms are looked at, and only as long as what
    is still to come may lift them to ``low``. None that reaches it is passed over."""
    ids = pa.concat_arrays([b[0] for b in block])
    by_id = pc.sort_indices(ids)
    place = np.empty(len(ids), np.int64)
    place[np.asarray(by_id)] = np.arange(len(ids))
    lens = np.concatenate([np.asarray(b[1].to_numpy(zero_copy_only=False), np.float64) for b in block])
    record = np.repeat(np.arange(len(ids)), np.concatenate([np.asarray(b[2].value_lengths().to_numpy(zero_copy_only=False)) for b in block]))
    t = np.concatenate([np.fromiter((at[w] for w in b[2].flatten().to_pylist()), np.int64) for b in block])
    tf = np.concatenate([np.asarray(b[3].flatten().to_numpy(zero_copy_only=False), np.float64) for b in block])
    part = weight[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[record] / avgdl))
    doc = place[record]
    by = np.argsort(t * len(ids) + doc)
    t, doc, part = t[by], doc[by], part[by]
    start = np.searchsorted(t, np.arange(len(weight) + 1))
    count = np.diff(start)
    high = np.zeros(len(weight))  # the most that a term adds in this block
    high[count > 0] = np.maximum.reduceat(part, start[:-1][count > 0]) if len(part) else 0
    whole: dict[int, np.ndarray] = {}  # what frequent terms add to every record
    for x in np.argsort(-count, kind="stable")[:WHOLE].tolist():
        if count[x] > len(ids) / 32:
            whole[x] = np.bincount(doc[start[x] : start[x + 1]], part[start[x] : start[x + 1]], len(ids))
    reach = np.add.reduceat(high[terms], first[:-1]) if len(terms) else np.zeros(0)
    lo, hi, most = start[:-1].tolist(), start[1:].tolist(), high.tolist()
    total = np.zeros(len(ids))
    found: tuple[list, list, list] = ([], [], [])
    for q in np.flatnonzero((reach > 0) & (reach >= best.low - EDGE)).tolist():
        low, n = float(best.low[q]) - EDGE, int(best.size[q])
        some = sorted((x for x in terms[first[q] : first[q + 1]].tolist() if hi[x] > lo[x]), key=most.__getitem__)
        weak, rest = 0, 0.0  # terms that don't bring records in, and the most that they add together
        while weak < len(some) - 1 and rest + most[some[weak]] < low:
            rest += most[some[weak]]
            weak += 1
        if weak == len(some) - 1:
            d, v = doc[lo[some[-1]] : hi[some[-1]]], part[lo[some[-1]] : hi[some[-1]]]
        else:
            for x in some[weak:]:
                total[doc[lo[x] : hi[x]]] += part[lo[x] : hi[x]]
            if low > 0:
                d = np.flatnonzero(total >= low - rest)
            else:
                d = np.flatnonzero(total)
            v = total[d]
            total[:] = 0
        for x in reversed(some[:weak]):
            ahead = v >= low - rest
            d, v = d[ahead], v[ahead]
            if not len(d):
                break
            rest -= most[x]
            if x in whole:
                v = v + whole[x][d]
            else:
                span = doc[lo[x] : hi[x]]
                near = np.minimum(np.searchsorted(span, d), len(span) - 1)
                v = v + np.where(span[near] == d, part[lo[x] : hi[x]][near], 0.0)
        ahead = v >= low
        d, v = d[ahead], v[ahead]
        if not len(d):
            continue
        r = np.round(v, 9)
        if len(d) > n > 0:
            enough = r >= np.partition(r, len(r) - n)[len(r) - n]
            d, v, r = d[enough], v[enough], r[enough]
        order = np.argsort(-r, kind="stable")[:n]
        found[0].append(np.full(len(order), q))
        found[1].append(d[order])
        found[2].append(v[order])
    if found[0]:
        best.add(ids.take(by_id), *map(np.concatenate, found))


def _score_postings(p: Postings, questions: DataFrame) -> DataFrame:
    """``qid, id, score`` by joining postings with the questions' terms; summed on the map side first."""
    stats, df = p.frames
    weights = df.crossJoin(F.broadcast(stats))  # one row
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    terms = query_terms(questions).join(weights, "term").select("qid", "term", idf(F.col("n"), F.col("df")).alias("idf"), avgdl.alias("avgdl"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return p.postings.join(small(terms), "term").groupBy("qid", "id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question, with ``rank``; WindowGroupLimit cuts below the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, questions: DataFrame, k: int = 10, allowed: DataFrame | None = None, postings: Postings | None = None, own: str | None = None) -> DataFrame:
    """``qid, id, score, rank``. ``allowed`` holds the ids that may be ranked; ``own`` names a column of the
    questions with the number of rows wanted of each, at most k (null: k)."""
    p = postings or asked_postings(docs, questions)
    if p.records is not None:
        return _score_records(p, questions, k, allowed, own)
    scored = _score_postings(p, questions)
    if allowed is not None:
        scored = scored.join(allowed, "id", "left_semi")
    if own is None:
        return top(scored, k)
    most = questions.groupBy("qid").agg(F.max(F.coalesce(own, F.lit(k))).alias("_most"))
    return top(scored, k).join(most, "qid").filter(F.col("rank") <= F.col("_most")).drop("_most")
