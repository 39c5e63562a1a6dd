"""Inverted index: postings, document lengths, document frequencies and corpus statistics.

Tokens are counted record by record over Arrow batches: all tokens of a record are in one row, so term
frequencies need no shuffle, and a worker remembers each word's stem. (Exploding the tokens and
grouping them again by record and term in the JVM took five times as long, see the README.)

Rows of one id that are repeated whole count once. Null texts count as empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection as AnyOf
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import distinct_rows, spread

_find = re.compile(T.TOKEN).findall
COUNTS = "id {}, dl int, term string, tf bigint"


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a side whose row count was checked; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def as_documents(rows: DataFrame, id: str = "id", text: Column | str | None = None) -> DataFrame:
    """``id, text`` once per record; only records whose id occurs again are shuffled to drop repeats."""
    body = T.indexed_text() if text is None else F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return distinct_rows(rows.select(F.col(id).alias("id"), body.alias("text")).filter(F.col("id").isNotNull()))


def record_lengths(docs: DataFrame) -> DataFrame:
    """``id, tokens, stems``: tokens of each record, and how many different stems there are among them."""
    stop = frozenset(T.STOPWORDS)
    memo: dict[str, tuple[bool, str | None]] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            if len(memo) > MEMO:
                memo.clear()
            got = [_count(memo, None, stop, text) for text in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array([dl for dl, _ in got], pa.int32()), pa.array([len(c) for _, c in got], pa.int32())], ["id", "tokens", "stems"])

    return spread(docs.select("id", "text")).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tokens int, stems int")


def _count(memo: dict[str, tuple[bool, str | None]], wanted: frozenset[str] | None, stop: frozenset[str], text: str | None) -> tuple[int, dict[str, int]]:
    """Length of a record and the counts of its (wanted) terms; the memo holds what becomes of a word."""
    from lodestone.operators.dense import stem

    counts: dict[str, int] = {}
    dl = 0
    for w, n in Counter(_find((text or "").lower())).items():
        known = memo.get(w)
        if known is None:
            s = None if w in stop else stem(w)
            known = memo[w] = (s is not None, s if wanted is None or s in wanted else None)
        if known[0]:
            dl += n
            if (s := known[1]) is not None:
                counts[s] = counts.get(s, 0) + n
    return dl, counts


#: Names that are no terms, for the totals of a batch.
RECORDS, TOKENS = "\0records", "\0tokens"
#: Words a worker remembers.
MEMO = 2_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """``id, dl, term, tf`` of all terms. Rows with the empty term carry, per batch, the number of records
    (``tf``) and of their tokens (``dl``), for the statistics."""
    stop = frozenset(T.STOPWORDS)
    memo: dict[str, tuple[bool, str | None]] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            if len(memo) > MEMO:
                memo.clear()
            row, dls, terms, tfs = [], [], [], []
            total = 0
            for k, text in enumerate(b[1].to_pylist()):
                dl, counts = _count(memo, None, stop, text)
                total += dl
                row += [k] * len(counts)
                dls += [dl] * len(counts)
                terms += counts.keys()
                tfs += counts.values()
            ids = pa.concat_arrays([b[0].take(pa.array(row, pa.int64())), pa.nulls(1, b[0].type)])
            yield pa.RecordBatch.from_arrays([ids, pa.array([*dls, total], pa.int32()), pa.array([*terms, ""], pa.string()), pa.array([*tfs, b.num_rows], pa.int64())], ["id", "dl", "term", "tf"])

    return spread(docs.select("id", "text")).mapInArrow(run, COUNTS.format(docs.schema["id"].dataType.simpleString()))


def record_counts(docs: DataFrame, vocabulary: AnyOf[str]) -> DataFrame:
    """``id, dl, terms, tfs``: the terms of ``vocabulary`` in each record that has any, one row a record.
    Rows with a null id carry, per batch, the number of records that have each of these terms, and as terms
    ``RECORDS`` and ``TOKENS`` the number of records and of their tokens."""
    stop = frozenset(T.STOPWORDS)
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))
    memo: dict[str, tuple[bool, str | None]] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            if len(memo) > MEMO:
                memo.clear()
            row, dls, terms, tfs = [], [], [], []
            total, seen = 0, Counter()
            for k, text in enumerate(b[1].to_pylist()):
                dl, counts = _count(memo, sent.value, stop, text)
                total += dl
                if counts:
                    seen.update(counts.keys())
                    row.append(k)
                    dls.append(dl)
                    terms.append(list(counts.keys()))
                    tfs.append(list(counts.values()))
            ids = pa.concat_arrays([b[0].take(pa.array(row, pa.int64())), pa.nulls(1, b[0].type)])
            terms.append([RECORDS, TOKENS, *seen.keys()])
            tfs.append([b.num_rows, total, *seen.values()])
            yield pa.RecordBatch.from_arrays([ids, pa.array([*dls, 0], pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "dl", "terms", "tfs"])

    return spread(docs.select("id", "text")).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, dl int, terms array<string>, tfs array<bigint>")


def batch_totals(counted: DataFrame) -> DataFrame:
    """``term, total`` of ``record_counts``: records per term, and the totals, from the rows that batches left."""
    left = counted.filter(F.col("id").isNull()).select(F.explode(F.arrays_zip("terms", "tfs")).alias("c"))
    return left.groupBy(F.col("c.terms").alias("term")).agg(F.sum("c.tfs").alias("total"))


def postings(docs: DataFrame) -> DataFrame:
    """``id, dl, term, tf``."""
    return term_counts(docs).filter(F.col("term") != "")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: ``n, avgdl``."""
    sums = batch_totals(record_counts(docs, ()))
    one = lambda name: F.coalesce(F.sum(F.when(F.col("term") == name, F.col("total"))), F.lit(0))
    totals = sums.agg(one(RECORDS).alias("n"), one(TOKENS).alias("dl"))
    return totals.select("n", F.when(F.col("n") > 0, F.col("dl") / F.col("n")).otherwise(0.0).alias("avgdl"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))
