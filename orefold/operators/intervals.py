"""Interval operators: overlap counts, merged islands and covered lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Buckets an interval is cut into at most; longer ones are matched by their keys alone.
MOST_BUCKETS = 256


def overlap_counts(targets: DataFrame, target_keys: Sequence[str], points: DataFrame, point_key: str, on: Sequence[str], width: int = 64) -> DataFrame:
    """For every target the number of distinct points' intervals that overlap any of its spans (closed, start..end), 0 if none.

    targets has one row per span. Both sides are cut into buckets of `width`, so that the join is an equi-join on (on, bucket) and a
    long or crowded file is spread over many tasks; each pair is kept once per target. Intervals of more than MOST_BUCKETS buckets, which
    real files hardly have, are joined on `on` instead. Intervals with a null end, or that end before they start, don't overlap.
    """
    valid = lambda df: df.where("start IS NOT NULL AND `end` IS NOT NULL AND start <= `end`")
    bucketed = lambda df: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    spans = valid(targets.select(*target_keys, *[c for c in on if c not in target_keys], "start", "end"))
    marks = valid(points.select(*on, point_key, "start", "end"))
    long = F.floor(F.col("end") / width) - F.floor(F.col("start") / width) >= MOST_BUCKETS
    renamed = lambda df: df.withColumnsRenamed({"start": "__s", "end": "__e"})
    pairs = [
        bucketed(spans.where(~long)).join(renamed(bucketed(marks.where(~long))), [*on, "__b"]),
        spans.where(long).join(renamed(marks), list(on)),
        spans.where(~long).join(renamed(marks.where(long)), list(on)),
    ]
    hits = reduce(DataFrame.unionByName, [p.where("start <= __e AND `end` >= __s").select(*target_keys, point_key) for p in pairs]).distinct()
    counted = hits.groupBy(*target_keys).agg(F.count("*").alias("n"))
    return targets.select(*target_keys).distinct().join(counted, list(target_keys), "left").na.fill(0, ["n"])


def merged_islands(intervals: DataFrame, keys: Sequence[str], touching: bool, start: str = "start", end: str = "end") -> DataFrame:
    """Unions of the intervals of each key. touching=True also joins [1, 3] and [4, 5] (lines); otherwise half-open
    intervals that only meet stay apart. One task holds the intervals of one key at a time, sorted, not gathered."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | ((F.col(start) > before + 1) if touching else (F.col(start) >= before)), 1).otherwise(0)
    numbered = intervals.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def covered(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The number of whole numbers that the closed intervals of each key cover."""
    islands = merged_islands(intervals, keys, True, start, end)
    return islands.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).cast("bigint").alias("covered"))
