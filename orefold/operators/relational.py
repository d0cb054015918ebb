"""Relational operators that any DataFrame can use; all lazy unless they say so."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefold.catalog import CONTRACT_VERSION, METRICS, catalog_frame
from orefold.functions.scalar import is_finite
from orefold.runtime import sorted_runs, spread_join


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key, the first by `order` and then by all columns: an aggregation with map-side combining, not a window."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("__first")
    return df.groupBy(*keys).agg(ranked).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def scope_rollup(rows: DataFrame, memberships: DataFrame, item: str, scope: str, sums: Sequence[str]) -> DataFrame:
    """Sums per item, per scope (through a many-to-many membership) and over all distinct items; not a ROLLUP, since items shared by
    scopes count in each of them and once in the whole. Columns: level, target, sums."""

    def total(df: DataFrame, level: str, by: Column) -> DataFrame:
        return df.groupBy(by.cast("string").alias("target")).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums]).select(F.lit(level).alias("level"), "target", *sums)

    scoped = memberships.select(item, scope).distinct().join(rows, item)
    return union_all([total(rows, "item", F.col(item)), total(scoped, "scope", F.col(scope)), total(rows, "all", F.lit("all"))])


def ratios(df: DataFrame, keep: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Long rows (keep, metric_id, value) of numerator / denominator; a zero or null denominator or a null numerator omits the row."""
    cells = [F.struct(F.lit(name).alias("metric_id"), (F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0))).alias("value")) for name, (a, b) in pairs.items()]
    return df.select(*keep, F.inline(F.array(*cells))).where("value IS NOT NULL")


def unpivot(df: DataFrame, keep: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Long rows (keep, metric_id, value), one per metric; a null column is an absent metric."""
    cells = [F.struct(F.lit(name).alias("metric_id"), F.col(c).cast("double").alias("value")) for name, c in columns.items()]
    return df.select(*keep, F.inline(F.array(*cells))).where("value IS NOT NULL")


def zero_filled(targets: DataFrame, keys: Sequence[str], measured: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every target with its measures, 0 where there are none."""
    return targets.join(measured, list(keys), "left").na.fill(0, list(columns))


def max_and_p95(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """max_<c> and p95_<c> (nearest rank) per key; null for a group without values."""
    aggs = [a for c in columns for a in (F.max(c).cast("bigint").alias(f"max_{c}"), F.expr(f"percentile_disc(0.95D) WITHIN GROUP (ORDER BY {c})").cast("bigint").alias(f"p95_{c}"))]
    return rows.groupBy(*keys).agg(*aggs)


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, pct: int) -> DataFrame:
    """Element ceil(pct * n / 100) of each group by a distributed sort, for groups of any size. Writes once to the shared folder."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    placed = sorted_runs(counts, keys, value, "nearest")
    at = F.greatest(F.expr(f"({pct} * total + 99) div 100"), F.lit(1))
    return placed.where((at > F.col("below")) & (at <= F.col("below") + F.col("cnt"))).select(*keys, F.col(value).alias("nearest"), F.col("total").alias("n"))


def ecdf(rows: DataFrame, keys: Sequence[str], value: str, out: str = "percentile") -> DataFrame:
    """The share of the group's non-null values that are at most this one, and 0 for values of 0 or less; null stays null.

    Ranks come from a distributed sort of distinct values, so no group is bound to one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    placed = sorted_runs(counts, keys, value, "ecdf").select(*keys, value, ((F.col("below") + F.col("cnt")) / F.col("total")).alias("__p"))
    joined = rows.join(placed, [*keys, value], "left")
    return joined.withColumn(out, F.when(F.col(value) <= 0, F.lit(0.0)).otherwise(F.col("__p"))).drop("__p")


def global_rank(rows: DataFrame, order: Sequence[Column], out: str = "rank_no") -> DataFrame:
    """Rows numbered 1..n in a total order, without a single-partition window; rows that tie share the smallest number."""
    keyed = rows.withColumn("__order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    placed = sorted_runs(keyed.groupBy("__order").agg(F.count("*").alias("cnt")), [], "__order", "rank")
    return keyed.join(placed.select("__order", (F.col("below") + 1).alias(out)), "__order").drop("__order")


def tag_slices(rows: DataFrame, keys: Sequence[str], tags: str) -> DataFrame:
    """Counts per key, in total (tag null) and per tag; a row counts once per distinct tag."""
    each = rows.select(*keys, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct(tags), F.array().cast("array<string>")))).alias("tag"))
    return each.groupBy(*keys, "tag").agg(F.count("*").alias("n"))


def merged_tags(rows: DataFrame, keys: Sequence[str], tags: str) -> DataFrame:
    """One row per key with the sorted union of its tags (null if none). Tags are told apart before they are gathered."""
    distinct = rows.select(*keys, F.explode_outer(tags).alias("__t")).distinct()
    merged = distinct.groupBy(*keys).agg(F.array_sort(F.collect_set("__t")).alias(tags))
    return merged.withColumn(tags, F.when(F.size(tags) > 0, F.col(tags)))


def distinct_degrees(edges: DataFrame, nodes: DataFrame, node: str, source: str = "from_id", target: str = "to_id", keys: Sequence[str] = ()) -> DataFrame:
    """The rows of nodes with fan_out and fan_in by distinct partners within keys; 0 for nodes without any. Edges go through one shuffle besides that of telling them apart."""
    pairs = edges.select(*keys, source, target).distinct()
    end = lambda c, o, i: F.struct(F.col(c).alias(node), F.lit(o).alias("o"), F.lit(i).alias("i"))
    counted = pairs.select(*keys, F.inline(F.array(end(source, 1, 0), end(target, 0, 1)))).groupBy(*keys, node).agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    return zero_filled(nodes, [*keys, node], counted, ["fan_out", "fan_in"])


def lifted_edges(edges: DataFrame, parents: DataFrame, child: str, parent: str, source: str = "from_id", target: str = "to_id") -> DataFrame:
    """Edges between the parents of their ends, distinct, without those within one parent."""
    up = parents.select(child, parent)
    first = spread_join(edges.select(F.col(source).alias(child), F.col(target).alias("__t")).distinct(), up, [child]).select(F.col(parent).alias("__p"), F.col("__t").alias(child))
    both = spread_join(first.distinct(), up, [child])
    return both.where(F.col("__p") != F.col(parent)).select(F.col("__p").alias(source), F.col(parent).alias(target)).distinct()


def with_known_ends(edges: DataFrame, nodes: DataFrame, node: str, source: str = "from_id", target: str = "to_id", keys: Sequence[str] = ()) -> DataFrame:
    """Edges of which both ends are nodes, within keys."""
    ids = nodes.select(*keys, node).distinct()
    kept = edges.join(ids.withColumnRenamed(node, source), [*keys, source], "left_semi")
    return kept.join(ids.withColumnRenamed(node, target), [*keys, target], "left_semi")


def dangling(rows: DataFrame, keys: Sequence[str], parents: DataFrame) -> DataFrame:
    """Rows whose key isn't null and isn't among the parents' rows of the same column names."""
    known = parents.select(*keys).distinct()
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rows.where(there).join(known, list(keys), "left_anti")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def longest_prefix(paths: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each path with the longest of the prefixes (directories) that contain it, null if none; '' contains all.

    A path is exploded into its own ancestors, which are equi-joined with the prefixes: no prefix is compared with every path. Of
    repeated prefixes one counts.
    """
    parts = F.split(F.col("__path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    distinct = paths.select(F.col(path).alias("__path")).where("__path IS NOT NULL").distinct()
    hits = distinct.select("__path", F.explode(above).alias(prefix)).join(prefixes.select(prefix).distinct(), prefix)
    best = hits.groupBy(F.col("__path").alias(path)).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return paths.join(best, path, "left")


def threshold_gaps(values: DataFrame, limits: DataFrame, on: Sequence[str], by: Sequence[str], value: str, also: Sequence[Column] = ()) -> DataFrame:
    """`gap`, the weighted excess over the limits (on, maximum, weight), per group of `by`; `also` are further aggregates of a group's rows."""
    over = F.greatest(F.lit(0.0), F.col(value) - F.col("maximum")) * F.col("weight")
    return values.join(limits, list(on)).groupBy(*by).agg(F.sum(over).alias("gap"), *also)


def gap_totals() -> list[Column]:
    """Aggregates of gaps: gap_sum, squared_gap_sum, violating_targets and max_target_gap."""
    return [
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_sum"), F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("squared_gap_sum"),
        F.count_if(F.col("gap") > 0).alias("violating_targets"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_target_gap"),
    ]


def threshold_debt(values: DataFrame, limits: DataFrame, target: str = "target_id", metric: str = "metric_id", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per group of `by`: gap_totals of the targets' weighted excess over the limits (metric, maximum, weight)."""
    return threshold_gaps(values, limits, [metric], [*by, target], value).groupBy(*by).agg(*gap_totals())


def top_ranked(rows: DataFrame, order: Sequence[Column], most: int, out: str = "rank_no") -> DataFrame:
    """The first `most` rows in a total order, numbered: each task keeps its own first ones, so nothing is ranked or sorted as a whole."""
    first = rows.orderBy(*order).limit(most)
    return first.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def population_hash(rows: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """SHA-256 of the sorted distinct paths of each group, joined by line feeds. A group is the files of one run, at most 250,000."""
    paths = rows.select(*keys, path).where(F.col(path).isNotNull()).distinct()
    return paths.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(path)), "\n"), 256).alias("population_sha256"))


def value_violations(rows: DataFrame) -> DataFrame:
    """Metric rows that break the catalog: `problem` says how; rows without problem are left out."""
    catalog = catalog_frame(rows.sparkSession).select(F.col("metric_id"), F.col("target_kinds").alias("__kinds"), F.col("value_kind").alias("__vk"))
    joined = rows.join(F.broadcast(catalog), "metric_id", "left")  # the catalog has 66 rows
    v = F.col("numeric_value")
    problem = (
        F.when(F.col("__kinds").isNull(), "unknown metric")
        .when(~F.array_contains("__kinds", F.col("target_kind")), "unsupported target kind")
        .when(v.isNull(), "no number")
        .when(~is_finite(v) | F.isnan(v), "not finite")
        .when((F.col("__vk") == "integer") & (v % 1 != 0), "fractional integer")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").drop("__kinds", "__vk")


def enriched(long: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long rows (metric_id, target..., value, tags) as observations: version, unit and value kind from the catalog; `keep` stays."""
    catalog = F.broadcast(catalog_frame(long.sparkSession).select("metric_id", "metric_version", "unit", "value_kind"))
    rows = long.join(catalog, "metric_id")
    return rows.select(
        *keep, F.lit(CONTRACT_VERSION).alias("schema_version"), "metric_id", "metric_version", "target_id", "target_kind", "target_id_stability", "value_kind",
        F.col("value").alias("numeric_value"), F.lit(None).cast("string").alias("string_value"), F.lit(None).cast("boolean").alias("bool_value"), "unit", "file_path",
        F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "tags",
    )


def catalog_values() -> str:
    """The catalog as SQL VALUES rows (metric_id, kinds, value_kind)."""
    return ", ".join(f"('{m.id}', ',{','.join(m.target_kinds)},', '{m.value_kind}')" for m in METRICS)


