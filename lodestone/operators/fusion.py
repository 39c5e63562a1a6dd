"""Reciprocal rank fusion of rankings of the same questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rrf(rankings: dict[str, DataFrame], k: int = K, keep: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``qid, id, score, ranks``: sum of 1/(k + rank) over the rankings (qid, id, rank).

    A union and one aggregate stand for the full outer join of the rankings; ``ranks`` maps the
    name of a ranking to its 1-based rank.
    """
    named = [d.select(*keep, "id", F.col("rank").cast("int").alias("rank"), F.lit(n).alias("ranking")) for n, d in rankings.items()]
    return fuse(reduce(DataFrame.unionByName, named), k, keep)


def fuse(ranked: DataFrame, k: int = K, keep: tuple[str, ...] = ("qid",)) -> DataFrame:
    """As ``rrf``, from one table with a column ``ranking``. An item has one rank per ranking, so the lists are short."""
    return ranked.groupBy(*keep, "id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("ranking", "rank")))).alias("ranks")
    )


def top(fused: DataFrame, n: int, keep: tuple[str, ...] = ("qid",), tie: str = "id") -> DataFrame:
    w = Window.partitionBy(*keep).orderBy(F.round("score", 9).desc(), F.col(tie))
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
