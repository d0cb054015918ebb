"""One ranking from several scores on different scales: a weighted Borda count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefold.runtime import null_safe_join, sorted_runs


def component_ranks(components: DataFrame, group: Sequence[str], value: str = "value", local: bool = False) -> DataFrame:
    """Competition ranks of every component within its group, ascending, ties averaged.

    components: one row per item and score, with the columns of group (which name the score and the set it is
    ranked in) and value. Added: `below` (values smaller), `ties` (equal values, itself included), `total`
    (non-null values of the group) and `avg_rank` = below + (ties + 1) / 2; all null where the value is null.
    NaN ranks above all numbers. Ranks come from a distributed sort of the distinct values, so a group may be of any size; the
    join back has one row on the right per distinct value. With `local` they come from a window over each group instead, the same in one sort, for
    groups that are known to fit a task. Columns of components that have the added names are replaced.
    """
    components = components.drop("below", "ties", "total", "avg_rank")
    if local:
        order = Window.partitionBy(*group).orderBy(value)
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        there = F.col(value).isNotNull()
        ranked = components.withColumns({"__rank": F.rank().over(order), "__upto": F.count(value).over(order), "__n": F.count("*").over(every), "total": F.count(value).over(every)})
        below = F.col("__rank") - 1 - (F.col("__n") - F.col("total"))
        placed = ranked.withColumns({"below": F.when(there, below), "ties": F.when(there, F.col("__upto") - below), "total": F.when(there, F.col("total"))}).drop("__rank", "__upto", "__n")
        return placed.withColumn("avg_rank", F.col("below") + (F.col("ties") + 1) / F.lit(2.0))
    counts = components.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("cnt"))
    ranks = sorted_runs(counts, group, value, "ranks").withColumnRenamed("cnt", "ties")
    joined = null_safe_join(components, ranks, group, [value], "left")
    return joined.withColumn("avg_rank", F.col("below") + (F.col("ties") + 1) / F.lit(2.0))


def borda_ranking(ranked: DataFrame, within: Sequence[str], kind: str, item: str, score: str, weight: str = "weight", local: bool = False) -> DataFrame:
    """One ranking of the items of each group `within` from component_ranks' rows.

    A score's points are its average rank as a share of its group, (avg_rank - 0.5) / total, so no score
    counts for more than its weight, whatever its range. A missing score has the mid-rank 0.5: where its row has a null value with its own
    weight, where the row is missing with the mean weight of that score among its kind. Weights are taken
    relative to the item's sum (null and negative ones as 0); an item without any weight has 0.5. Ranks are 1..n by points descending,
    then item. With `local`, windows over each group of `within` take the place of joins and of the distributed sort, for groups that are known
    to fit a task. Columns: within, kind, item, points, rank_no.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    points = F.coalesce((F.col("avg_rank") - 0.5) / F.col("total"), F.lit(0.5))
    share = F.when(F.col("__full") > 0, F.col("__held") / F.col("__full")).otherwise(F.lit(1.0))
    own = F.when(F.col("__w") > 0, F.col("__wp") / F.col("__w")).otherwise(F.lit(0.5))
    scored_points = F.round(own * share + (1 - share) * 0.5, 12)
    if local:
        of_score = Window.partitionBy(*within, kind, score)
        rows = ranked.select(*within, kind, item, w.alias("__w"), (w * points).alias("__wp"), F.avg(w).over(of_score).alias("__mean"), F.count("*").over(of_score).alias("__n"))
        per_item = rows.groupBy(*within, kind, item).agg(F.sum("__w").alias("__w"), F.sum("__wp").alias("__wp"), F.sum("__mean").alias("__held"), F.sum(F.col("__mean") / F.col("__n")).alias("__part"))
        full = per_item.withColumn("__full", F.sum("__part").over(Window.partitionBy(*within, kind)))
        scored = full.select(*within, kind, item, scored_points.alias("points"))
        place = F.row_number().over(Window.partitionBy(*within).orderBy(F.col("points").desc(), item, kind))
        return scored.withColumn("rank_no", place.cast("bigint"))
    per_item = ranked.groupBy(*within, kind, item).agg(F.sum(w).alias("__w"), F.sum(w * points).alias("__wp"))
    per_score = ranked.groupBy(*within, kind, score).agg(F.avg(w).alias("__mean"))
    full = per_score.groupBy(*within, kind).agg(F.count(score).alias("__all"), F.sum("__mean").alias("__full"))
    held = null_safe_join(ranked, per_score, [*within, kind, score]).groupBy(*within, kind, item).agg(F.sum("__mean").alias("__held"))
    # weights of an item and of its kind may be on different scales: the held part of the mean weights says how much is missing
    both = null_safe_join(null_safe_join(per_item, held, [*within, kind, item]), full, [*within, kind])
    scored = both.select(*within, kind, item, scored_points.alias("points"))
    order = scored.withColumn("__order", F.struct((-F.col("points")).alias("p"), F.col(item).alias("i"), F.col(kind).alias("k")))
    ranks = sorted_runs(order.groupBy(*within, "__order").agg(F.count("*").alias("cnt")), within, "__order", "borda")
    return ranks.select(*within, F.col("__order.k").alias(kind), F.col("__order.i").alias(item), (-F.col("__order.p")).alias("points"), (F.col("below") + 1).alias("rank_no"))


def ecdf_scores(ranked: DataFrame, item_keys: Sequence[str], value: str = "value", weight: str = "weight", also: Sequence[Column] = ()) -> DataFrame:
    """The weighted mean of the components' empirical percentiles from the same ranks.

    A percentile is (below + ties) / total, and 0 for values of 0 or less; components without a value or weight don't count; an item
    without any has a null score. `also` are further aggregates of an item's rows.
    """
    pct = F.when(F.col(value) <= 0, F.lit(0.0)).otherwise((F.col("avg_rank") + (F.col("ties") - 1) / F.lit(2.0)) / F.col("total"))
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return ranked.groupBy(*item_keys).agg((F.sum(w * pct) / F.when(F.sum(w) != 0, F.sum(w))).alias("score"), *also)
