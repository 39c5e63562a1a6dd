"""One ranking from several differently-scaled scores: reciprocal rank fusion.

Items are ranked separately by each retriever and ``sum(1 / (60 + rank))`` decides, so that only the
order counts that a score gives, never its scale, spread or tail. A retriever's rank of an item is the
one it reported (``ranks[retriever]``); where that is missing, it is read off the scores, in the
direction in which the retriever's scores and reported ranks run over the whole table.

Edge cases: retriever names agree regardless of case and outer blanks; rows repeated under another
hit_id count once; NaN scores count as missing; an item with neither score nor rank comes after the
retriever's others; hits without ask, retriever or id are ignored; ties go to the smaller id. A
retriever of which no direction can be told is taken as "more is better".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

K = 60
#: Hits of one ask by one retriever that are ordered in one task; larger groups are ordered over many.
GROUP = 500_000


def unique_hits(hits: DataFrame) -> DataFrame:
    """``ask_id, retriever, id, score, rank``: one row per ask, retriever and item."""
    name = F.lower(F.trim("retriever"))
    rows = hits.select("ask_id", name.alias("retriever"), "id", F.when(~F.isnan("score"), F.col("score")).alias("score"), "ranks")
    rows = rows.filter(F.col("ask_id").isNotNull() & F.col("retriever").isNotNull() & F.col("id").isNotNull())
    own = F.filter(F.map_entries("ranks"), lambda e: F.lower(F.trim(e["key"])) == F.col("retriever"))
    rank = F.get(own, F.lit(0))["value"]
    rows = rows.withColumn("rank", F.when(rank > 0, rank))
    return rows.groupBy("ask_id", "retriever", "id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))


def directions(unique: DataFrame) -> DataFrame:
    """``retriever, sign``: 1 if a greater score is the better one, else -1, over all asks."""
    per_ask = unique.filter(F.col("score").isNotNull() & F.col("rank").isNotNull()).groupBy("retriever", "ask_id").agg(F.corr("score", "rank").alias("r"))
    votes = F.sum(F.signum(F.when(~F.isnan("r"), F.col("r"))))
    return per_ask.groupBy("retriever").agg(F.when(F.coalesce(votes, F.lit(0.0)) > 0, -1.0).otherwise(1.0).alias("sign"))


def retriever_ranks(hits: DataFrame) -> DataFrame:
    """``ask_id, retriever, id, place``: each item's rank by each retriever.

    Items without a reported rank take, in the order of their scores, the ranks that no item reported:
    the j-th free rank is j plus the number of reported ranks with fewer than j free ones below. Where
    ranks are missing from the table altogether, none goes above a better-scored item's reported rank.
    Groups of more than ``GROUP`` hits get the same places from ``_places_in_parts``.
    """
    u = unique_hits(hits)
    u = u.join(directions(u), "retriever", "left").withColumn("better", F.col("score") * F.coalesce("sign", F.lit(1.0)))
    # repeated rows included, so that the names alone are read
    sizes = hits.groupBy("ask_id", F.lower(F.trim("retriever")).alias("retriever")).agg(F.count("*").alias("n"))
    big = cut_lineage(sizes.filter(F.col("n") > GROUP).select(*_GROUP))
    if big.isEmpty():
        return _places(u)
    side = F.broadcast(big)  # at most one in GROUP hits
    return _places(u.join(side, _GROUP, "left_anti")).unionByName(_places_in_parts(u.join(side, _GROUP, "left_semi")))


_GROUP = ["ask_id", "retriever"]


def _by_score() -> list[Column]:
    # of equal scores the unranked come first, so that only strictly better ranked items are above them
    return [F.col("better").desc_nulls_last(), F.col("rank").asc_nulls_first(), F.col("id")]


def _places(u: DataFrame) -> DataFrame:
    group, by_score = _GROUP, _by_score()
    before = Window.partitionBy(*group).orderBy(*by_score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unranked = F.col("rank").isNull()
    u = u.withColumn("above", F.coalesce(F.max(F.when(F.col("better").isNotNull(), F.col("rank"))).over(before), F.lit(0)))
    u = u.withColumn("j", F.sum(F.when(unranked, 1).otherwise(0)).over(before))
    since = Window.partitionBy(*group, "above").orderBy(*by_score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("after", F.col("above") + F.sum(F.when(unranked, 1).otherwise(0)).over(since))
    by_rank = Window.partitionBy(*group, unranked).orderBy("rank", "id")
    u = u.withColumn("free_below", F.when(unranked, F.col("j")).otherwise(F.col("rank") - F.row_number().over(by_rank)))
    w = Window.partitionBy(*group).orderBy("free_below", unranked.desc(), "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = F.col("j") + F.sum(F.when(unranked, 0).otherwise(1)).over(w)
    return u.select(*group, "id", F.coalesce(F.col("rank"), F.greatest(free, F.col("after"))).cast("int").alias("place"))


def _in_parts(rows: DataFrame, order: list[Column], group: list[str] = _GROUP) -> DataFrame:
    """The rows range-partitioned by group and order, with the number of their partition; written, so that it stays."""
    return cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))


def _add(here: Column, before: Column) -> Column:
    return here + F.coalesce(before, F.lit(0))


def _running(rows: DataFrame, order: list[Column], name: str, fold: Callable[[Column], Column], value: Column, join: Callable[[Column, Column], Column] = _add, group: list[str] = _GROUP) -> DataFrame:
    """A running aggregate over each group's order: within a partition by a window, and before it by one over the
    partitions' aggregates, of which a group has as many as partitions."""
    here = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_p", *group).agg(fold(value).alias("_t")).withColumn("_before", fold(F.col("_t")).over(earlier))
    rows = rows.withColumn("_here", fold(value).over(here)).join(parts.drop("_t"), ["_p", *group])
    return rows.withColumn(name, join(F.col("_here"), F.col("_before"))).drop("_here", "_before")


def _places_in_parts(u: DataFrame) -> DataFrame:
    """As ``_places``, with no group in one task: three orders, each over range partitions."""
    unranked = F.col("rank").isNull()
    u = _running(_in_parts(u, _by_score()), _by_score(), "j", F.sum, F.when(unranked, 1).otherwise(0))
    # the highest rank above an item, and how many unranked items stood above the first that has it
    top = F.when(F.col("better").isNotNull() & ~unranked, F.struct("rank", (-F.col("j")).alias("j")))
    u = _running(u, _by_score(), "top", F.max, top, F.greatest)
    above = F.coalesce(F.col("top.rank"), F.lit(0))
    u = cut_lineage(u.withColumn("after", above + F.col("j") + F.coalesce(F.col("top.j"), F.lit(0))).drop("_p", "top"))
    by_rank = [F.col("rank"), F.col("id")]
    ranked = _running(_in_parts(u.filter(~unranked), by_rank), by_rank, "nth", F.sum, F.lit(1)).withColumn("free_below", F.col("rank") - F.col("nth")).drop("_p", "nth")
    u = ranked.unionByName(u.filter(unranked).withColumn("free_below", F.col("j")))
    by_free = [F.col("free_below"), unranked.desc(), F.col("j")]
    u = _running(_in_parts(u, by_free), by_free, "taken", F.sum, F.when(unranked, 0).otherwise(1))
    return u.select(*_GROUP, "id", F.coalesce(F.col("rank"), F.greatest(F.col("j") + F.col("taken"), F.col("after"))).cast("int").alias("place"))


def fuse(hits: DataFrame, k: int = K) -> DataFrame:
    """``ask_id, id, score, ranks, place``: the fused ranking of every ask; large ones are ordered in parts."""
    places = retriever_ranks(hits)
    fused = places.groupBy("ask_id", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("place"))), 12).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("retriever", "place")))).alias("ranks")
    )
    fused = cut_lineage(fused)
    order, ask = [F.col("score").desc(), F.col("id")], ["ask_id"]
    place = lambda rows: rows.withColumn("place", F.row_number().over(Window.partitionBy(*ask).orderBy(*order)))
    big = fused.groupBy(*ask).agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select(*ask)
    if big.isEmpty():
        return place(fused)
    side = F.broadcast(big)  # at most one in GROUP items
    parts = _in_parts(fused.join(side, ask, "left_semi"), order, ask)
    many = _running(parts, order, "place", F.sum, F.lit(1), group=ask).drop("_p").withColumn("place", F.col("place").cast("int"))
    return place(fused.join(side, ask, "left_anti")).unionByName(many)


def winners(hits: DataFrame, k: int = K) -> DataFrame:
    """``ask_id, id``: the item that comes first in each ask. No sort: one aggregate per ask."""
    fused = retriever_ranks(hits).groupBy("ask_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 12).alias("score"))
    return fused.groupBy("ask_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("best")).select("ask_id", F.col("best.id").alias("id"))
