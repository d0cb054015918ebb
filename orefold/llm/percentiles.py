"""Exact percentiles of very large numeric columns, from mergeable value counts and a distributed sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.runtime import sorted_runs


def value_counts(rows: DataFrame, keys: Sequence[str], value: str, grain: float | None = None) -> DataFrame:
    """Partial results: one row per keys and finite value, with its count `cnt`; nulls, NaN and infinities are left out.

    grain=None keeps values exact. With grain = g, values are rounded to within a relative error of g, which bounds the rows
    of a group by the logarithm of its range; percentiles from such partials are off by at most g, relatively.
    """
    v = F.col(value).cast("double")
    kept = rows.where(v.isNotNull() & (F.abs(v) < float("inf"))).select(*keys, (v + 0.0).alias("value"))
    if grain is not None:
        step = F.log1p(F.lit(2.0 * grain))
        # buckets are (1 + 2g)^k wide; their middle is within g of every member
        level = F.exp((F.floor(F.log(F.abs(F.col("value"))) / step) + 0.5) * step)
        kept = kept.withColumn("value", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.signum("value") * level))
    return kept.groupBy(*keys, "value").agg(F.count("*").alias("cnt"))


def merge_counts(partials: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Partials of runs, days or partitions as one, for the same keys or for fewer of them."""
    united = partials[0].select(*keys, "value", "cnt")
    for p in partials[1:]:
        united = united.unionByName(p.select(*keys, "value", "cnt"))
    return united.groupBy(*keys, "value").agg(F.sum("cnt").alias("cnt"))


def percentiles(partials: DataFrame, keys: Sequence[str], pcts: Sequence[float]) -> DataFrame:
    """Nearest-rank and interpolated percentiles of each group of merged value counts.

    nearest: element ceil(pct * n / 100) in ascending order (the first for pct 0); interpolated: between the order statistics
    around (n - 1) * pct / 100. The values are sorted over the whole cluster, each group's offset in each partition comes from the
    partitions' counts, and only the rows that cover a target position go on. Columns: keys, pct, n,
    nearest, interpolated. Groups without a finite value have no row.
    """
    placed = sorted_runs(partials, keys, "value", "percentiles")
    bp = F.col("bp")  # hundredths of a percent, for integer positions
    wanted = F.explode(F.array(*[F.lit(round(p * 100)).cast("long") for p in pcts])).alias("bp")
    n, below, upto = F.col("total"), F.col("below"), F.col("below") + F.col("cnt")
    exact_at = F.greatest(F.expr("(bp * total + 9999) div 10000"), F.lit(1))
    low = F.expr("(total - 1) * bp div 10000")
    high = F.least(low + 1, n - 1)
    covers = lambda k: (k > below) & (k <= upto)
    hit = placed.select(*keys, "value", "cnt", "below", "total", wanted).where(covers(exact_at) | covers(low + 1) | covers(high + 1))
    found = hit.groupBy(*keys, "bp").agg(
        F.max("total").alias("n"),
        F.max(F.when(covers(exact_at), F.col("value"))).alias("nearest"),
        F.max(F.when(covers(low + 1), F.col("value"))).alias("__low"),
        F.max(F.when(covers(high + 1), F.col("value"))).alias("__high"),
        F.max(F.expr("(total - 1) * bp % 10000") / F.lit(10000.0)).alias("__part"),
    )
    between = F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")
    return found.select(*keys, (bp / F.lit(100.0)).alias("pct"), "n", "nearest", between.alias("interpolated"))
