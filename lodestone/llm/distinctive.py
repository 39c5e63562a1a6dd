"""How distinctive a term is for its record: log-odds with an informative Dirichlet prior.

For term w with ``tf`` of the record's ``n`` terms, ``cf`` of the collection's N, and a prior of
``prior`` pseudo-counts spread as the collection is (alpha = prior * cf / N):

    delta = ln((tf + alpha) / (n + prior - tf - alpha)) - ln((y + alpha) / (N - n + prior - y - alpha)),  y = cf - tf
    z     = delta / sqrt(1 / (tf + alpha) + 1 / (y + alpha))

so that common terms score about 0 and rare shared ones high. Collection counts cover every record.

Edge cases: a null heading or text counts as empty; a row repeated whole counts once; rows of one id
that differ are scored apart, but df counts distinct ids, so that they add one to it; records without
terms give no rows; an empty table gives none; other columns are ignored. In a collection of one distinct
term the odds are infinite on either side, z is NaN.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, distinct_rows, spread

TERM = r"[a-z0-9]+(?:[._-][a-z0-9]+)*"
_find = re.compile(TERM).findall
#: Distinct terms a task holds before it hands on its partial counts.
FLUSH = 400_000


def record_terms(heading: str | None, text: str | None) -> list[str]:
    return _find(f"{heading or ''}\n{text or ''}".lower())


def _vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    cf: Counter[str] = Counter()
    df: Counter[str] = Counter()
    records = 0

    def out() -> pa.RecordBatch:
        cf[""], df[""] = sum(cf.values()), records
        b = pa.RecordBatch.from_arrays([pa.array(cf.keys(), pa.string()), pa.array(cf.values(), pa.int64()), pa.array([df[t] for t in cf], pa.int64())], ["term", "cf", "df"])
        cf.clear()
        df.clear()
        return b

    for b in batches:
        for heading, text in zip(b[1].to_pylist(), b[2].to_pylist()):
            terms = record_terms(heading, text)
            records += 1
            cf.update(terms)
            df.update(set(terms))
        if len(cf) > FLUSH:
            yield out()
            records = 0
    if records:
        yield out()


def records_once(rows: DataFrame) -> DataFrame:
    """``id, heading, text, again``: the distinct records; ``again`` is false where no other row has the id."""
    return distinct_rows(spread(rows.select("id", "heading", "text")), "id", "again")


def collection_counts(once: DataFrame) -> DataFrame:
    """``term, cf, df`` of ``records_once``; the row of the empty term holds the total of terms and of ids.

    Each task counts its records before anything is shuffled. Only of ids that come with several rows the
    terms are brought together by id first, so that df counts ids.
    """
    single = once.filter(~F.col("again")).select("id", "heading", "text").mapInArrow(_vocabulary, "term string, cf bigint, df bigint")
    several = once.filter("again").select("id", "heading", "text").mapInArrow(_records(True), "id string, term string, tf int, n int")
    by_id = several.groupBy("id", "term").agg(F.sum("tf").alias("cf"))
    per_term = by_id.groupBy("term").agg(F.sum("cf").alias("cf"), F.count("*").alias("df"))
    return single.unionByName(per_term).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _records(totals: bool = False, frequent: Broadcast[frozenset[str]] | None = None, inside: bool = False):
    """Terms of each record, of ``frequent`` only those inside or outside; ``totals`` adds a row of the empty
    term with the record's number of terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = None if frequent is None else frequent.value
        for b in batches:
            ids, terms, tfs, ns = [], [], [], []
            for i, heading, text in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist()):
                found = record_terms(heading, text)
                n = len(found)
                counts = Counter(found)
                if totals:
                    counts[""] = n
                if held is not None:
                    counts = {t: k for t, k in counts.items() if (t in held) is inside}
                ids.extend([i] * len(counts))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                ns.extend([n] * len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(ns, pa.int32())], ["id", "term", "tf", "n"])

    return run


def term_scores(rows: DataFrame, prior: float = 500.0, min_count: int = 1, max_df: int | None = None) -> DataFrame:
    """``id, term, tf, cf, df, z`` for each term of each record, a row each.

    ``min_count`` and ``max_df`` choose among the scored rows: every term is scored, whether its row is
    wanted or not. Terms in more than one record in a thousand get their counts by broadcast, so that no key
    of the shuffled join is hot: there are at most 1000 times the mean number of distinct terms per record of
    them. They are most of the rows; reading the texts a second time for them is cheaper than their shuffle.
    """
    once = records_once(rows)
    counts = cut_lineage(collection_counts(once))
    total = counts.filter(F.col("term") == "").first()
    if total is None or not total["cf"]:
        return rows.sparkSession.createDataFrame([], "id string, term string, tf int, cf bigint, df bigint, z double")
    often = max(1000, total["df"] // 1000)
    counts = counts.filter(F.col("term") != "")
    frequent, rare = counts.filter(F.col("df") > often), counts.filter(F.col("df") <= often)
    names = frozenset(r["term"] for r in frequent.select("term").collect())
    shared = rows.sparkSession.sparkContext.broadcast(names)
    records = [once.select("id", "heading", "text").mapInArrow(_records(False, shared, inside), "id string, term string, tf int, n int") for inside in (False, True)]
    scored = records[0].join(rare, "term", "left")
    if names:
        scored = scored.unionByName(records[1].join(F.broadcast(frequent), "term", "left"))
    big_n = F.lit(float(total["cf"]))
    tf, n, y = F.col("tf").cast("double"), F.col("n").cast("double"), (F.col("cf") - F.col("tf")).cast("double")
    alpha = F.lit(prior) * F.col("cf") / big_n
    delta = F.log((tf + alpha) / (n + prior - tf - alpha)) - F.log((y + alpha) / (big_n - n + prior - y - alpha))
    z = F.when(F.col("cf") == total["cf"], F.lit(math.nan)).otherwise(delta / F.sqrt(1 / (tf + alpha) + 1 / (y + alpha)))
    scored = scored.select("id", "term", "tf", "cf", "df", z.alias("z"))
    if min_count <= 1 and max_df is None:
        return scored
    wanted = F.col("tf") >= min_count
    if max_df is not None:
        wanted &= F.col("df") <= max_df
    # one condition, which needs z (null fails it, NaN doesn't): of several the optimiser would move those on counts
    # below the scoring, and drop z where the caller does
    return scored.filter(F.when(F.col("z") > -math.inf, wanted).otherwise(F.raise_error(F.lit("a term without a score"))))
