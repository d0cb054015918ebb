"""The explainable hotspot ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.functions.scalar import file_name, short_number
from orefold.operators.relational import ecdf, enriched, union_all
from orefold.operators.snapshots import untagged
from orefold.plans.facts import RUN, Facts, unique_files
from orefold.runtime import sorted_runs

#: Component weights by kind of target, in the order of the report. Fixed values.
WEIGHTS = {
    "member": (("cognitive_complexity", 0.30), ("cyclomatic_complexity", 0.25), ("nesting_depth", 0.15), ("member_length", 0.15), ("diagnostic_count", 0.10), ("parameter_count", 0.05)),
    "type": (("max_member_cognitive_complexity", 0.25), ("p95_member_cyclomatic_complexity", 0.20), ("outgoing_type_dependency_count", 0.20), ("lines_of_code", 0.15), ("member_count", 0.10), ("diagnostic_count", 0.10)),
    "file": (("p95_member_cognitive_complexity", 0.25), ("p95_member_cyclomatic_complexity", 0.20), ("lines_of_code", 0.20), ("diagnostic_count", 0.15), ("type_count", 0.10), ("member_count", 0.10)),
}
KINDS = tuple(WEIGHTS)
TOP = 20


def candidates(facts: Facts) -> DataFrame:
    """Members, types and files that take part."""
    cols = ["target_id", "target_id_stability", "file_path", "start_line", "end_line"]
    part = lambda df, kind, name: df.select(RUN, F.lit(kind).alias("target_kind"), name.alias("target_name"), *cols)
    return union_all([part(facts.members, "member", F.col("name")), part(facts.types, "type", F.col("name")), part(unique_files(facts), "file", file_name(F.col("file_path")))])


def weights_frame(df: DataFrame) -> DataFrame:
    rows = [(kind, m, w, n) for kind, parts in WEIGHTS.items() for n, (m, w) in enumerate(parts)]
    return df.sparkSession.createDataFrame(rows, "target_kind string, metric_id string, raw_weight double, place int")


def rank(targets: DataFrame, metrics: DataFrame, health: DataFrame) -> DataFrame:
    """Every candidate with rank_score, rank_no (within its run), components and reasons.

    A component's percentile is its empirical one within run, kind and metric (0 for values of 0 or less); missing components are left out
    and the weights of the others add up to 1. Percentiles and then scores are rounded to 6 digits, half away from zero. Ties
    are ordered by kind and target id.
    """
    weights = F.broadcast(weights_frame(targets))  # 18 rows
    with_diagnostics = health.where("diagnostics_included_in_hotspot_rank").select(RUN, F.lit(True).alias("__diag")).distinct()
    values = metrics.where(untagged()).select(RUN, "target_kind", "target_id", "metric_id", F.col("numeric_value").alias("value")).join(weights, ["target_kind", "metric_id"])
    values = values.join(with_diagnostics, RUN, "left").where("metric_id <> 'diagnostic_count' OR __diag").drop("__diag")
    known = values.join(targets.select(RUN, "target_kind", "target_id"), [RUN, "target_kind", "target_id"], "left_semi")
    pct = ecdf(known, [RUN, "target_kind", "metric_id"], "value").withColumn("percentile", F.round("percentile", 6))
    part = F.struct("place", "metric_id", "value", "percentile", "raw_weight")
    grouped = pct.groupBy(RUN, "target_kind", "target_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["raw_weight"])
    parts = F.transform("parts", lambda p: F.struct(p["metric_id"].alias("metric_id"), p["value"].alias("value"), p["percentile"].alias("percentile"), (p["raw_weight"] / total).alias("weight")))
    scored = targets.join(grouped, [RUN, "target_kind", "target_id"], "left").withColumn("components", F.coalesce(parts, F.array().cast("array<struct<metric_id:string,value:double,percentile:double,weight:double>>")))
    up = F.aggregate("components", F.lit(0.0), lambda a, p: a + p["percentile"] * p["weight"])
    down = F.aggregate("components", F.lit(0.0), lambda a, p: a + p["weight"])
    scored = scored.withColumn("rank_score", F.when(down > 0, F.round(up / down, 6)).otherwise(0.0)).drop("parts")
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("target_kind"))
    order = scored.withColumn("__order", F.struct((-F.col("rank_score")).alias("s"), kind.alias("k"), F.col("target_id").alias("t")))
    placed = sorted_runs(order.groupBy(RUN, "__order").agg(F.count("*").alias("cnt")), [RUN], "__order", "hotspots")
    ranked = order.join(placed.select(RUN, "__order", (F.col("below") + 1).cast("int").alias("rank_no")), [RUN, "__order"]).drop("__order")
    return ranked.withColumn("reasons", reasons())


def reasons():
    """Component texts, the heaviest contribution first, then by metric; components of percentile 0 are left out."""
    telling = F.filter("components", lambda c: c["percentile"] > 0)
    ordered = F.array_sort(F.transform(telling, lambda c: F.struct((-(c["percentile"] * c["weight"])).alias("a"), c["metric_id"].alias("b"), c["value"].alias("v"), c["percentile"].alias("p"), c["weight"].alias("w"))))
    return F.transform(ordered, lambda c: F.concat(c["b"], F.lit("="), short_number(c["v"], 6), F.lit(" p"), short_number(c["p"]), F.lit(" w"), short_number(c["w"])))


def top_hotspots(ranked: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each run with a score above 0."""
    cols = [RUN, "target_id", "target_kind", "target_name", "rank_no", "rank_score", "file_path", "start_line", "end_line", "reasons", "components"]
    return ranked.where((F.col("rank_score") > 0) & (F.col("rank_no") <= top)).select(*cols)


def rank_metrics(ranked: DataFrame) -> DataFrame:
    """The hotspot_rank observation of every candidate."""
    cols = [RUN, "target_kind", "target_id", "target_id_stability", "file_path", "start_line", "end_line"]
    rows = ranked.select(*cols, F.lit(None).cast("array<string>").alias("tags"), F.lit("hotspot_rank").alias("metric_id"), F.col("rank_no").cast("double").alias("value"))
    return enriched(rows, [RUN])
