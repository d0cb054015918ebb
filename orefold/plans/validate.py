"""Validation of artifacts: one DataFrame of violations; valid means empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.catalog import CONTRACT_VERSION, KINDS
from orefold.operators.relational import dangling, duplicate_keys, union_all, value_violations
from orefold.plans.facts import RUN

_EDGE_KINDS = ("declares", "contains", "depends_on", "inherits", "implements", "uses_type", "calls")
_STABILITIES = ("semantic", "syntax_fallback", "line_fallback")


def _found(df: DataFrame, artifact: str, rule: str, detail: Column) -> DataFrame:
    return df.select(RUN, F.lit(artifact).alias("artifact"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def node_violations(nodes: DataFrame) -> DataFrame:
    """Missing properties, unknown kinds and stabilities, and ids that occur more than once."""
    bad = F.col("id").isNull() | F.col("kind").isNull() | F.col("name").isNull() | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | ~F.coalesce(F.col("target_id_stability").isin(*_STABILITIES), F.lit(False))
    twice = duplicate_keys(nodes.where("id IS NOT NULL"), [RUN, "id"])
    return _found(nodes.where(bad), "graph", "node schema", F.col("id")).unionByName(_found(twice, "graph", "duplicate node", F.col("id")))


def edge_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unknown kinds, missing ends and ends that are no nodes of the run."""
    bad = F.col("from_id").isNull() | F.col("to_id").isNull() | ~F.coalesce(F.col("kind").isin(*_EDGE_KINDS), F.lit(False))
    ids = nodes.select(RUN, "id").where("id IS NOT NULL").distinct()
    ends = edges.select(RUN, F.explode(F.array("from_id", "to_id")).alias("id")).where("id IS NOT NULL").distinct()
    return _found(edges.where(bad), "graph", "edge schema", F.concat_ws(" ", "from_id", "kind", "to_id")).unionByName(_found(dangling(ends, [RUN, "id"], ids), "graph", "missing edge end", F.col("id")))


def target_violations(rows: DataFrame, nodes: DataFrame, artifact: str) -> DataFrame:
    """Targets without a node, or with another kind or stability than the node's; each target once."""
    known = nodes.groupBy(RUN, F.col("id").alias("target_id")).agg(F.first("kind").alias("__k"), F.first("target_id_stability").alias("__s"))
    refs = rows.select(RUN, "target_id", "target_kind", "target_id_stability").distinct().join(known, [RUN, "target_id"], "left")
    rule = F.when(F.col("__k").isNull(), "missing node").when(F.col("target_kind") != F.col("__k"), "target kind").when(F.col("target_id_stability") != F.col("__s"), "target id stability")
    return refs.withColumn("rule", rule).where("rule IS NOT NULL").select(RUN, F.lit(artifact).alias("artifact"), "rule", F.col("target_id").alias("detail"))


def metric_violations(metrics: DataFrame) -> DataFrame:
    """Rows against the catalog, rows without exactly one value of their kind, and keys (target, metric, version, set of tags) that repeat."""
    of_catalog = value_violations(metrics)
    number = F.col("value_kind").isin("integer", "number")
    present = F.col("numeric_value").isNotNull().cast("int") + F.col("string_value").isNotNull().cast("int") + F.col("bool_value").isNotNull().cast("int")
    right = F.when(number, F.col("numeric_value").isNotNull()).when(F.col("value_kind") == "string", F.col("string_value").isNotNull()).when(F.col("value_kind") == "boolean", F.col("bool_value").isNotNull()).otherwise(False)
    wrong = metrics.where((present != 1) | ~F.coalesce(right, F.lit(False)))
    keyed = metrics.withColumn("__tags", F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ","))
    twice = duplicate_keys(keyed, [RUN, "target_id", "metric_id", "metric_version", "__tags"])
    return union_all(
        [
            of_catalog.select(RUN, F.lit("metrics").alias("artifact"), F.col("problem").alias("rule"), F.concat_ws(" ", "metric_id", "target_id").alias("detail")),
            _found(wrong, "metrics", "value of its kind", F.concat_ws(" ", "metric_id", "target_id")),
            _found(twice, "metrics", "duplicate observation", F.concat_ws(" ", "metric_id", "target_id")),
            _found(metrics.where(F.coalesce(F.col("schema_version"), F.lit("")) != CONTRACT_VERSION), "metrics", "schema version", F.col("schema_version")),
        ]
    )


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """Missing properties, impossible lines, hashes of another form and repeated ids."""
    bad = (
        F.col("chunk_id").isNull() | F.col("target_id").isNull() | F.col("text_hash").isNull() | ~F.coalesce(F.col("text_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))
        | ~F.coalesce((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.lit(False)) | (F.col("token_estimate") < 0)
    )
    return _found(chunks.where(bad), "chunks", "chunk schema", F.col("chunk_id")).unionByName(_found(duplicate_keys(chunks.where("chunk_id IS NOT NULL"), [RUN, "chunk_id"]), "chunks", "duplicate chunk", F.col("chunk_id")))


def diagnostic_violations(diagnostics: DataFrame) -> DataFrame:
    """Missing properties, unknown severities and impossible lines."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    known = F.coalesce(F.col("severity").isin("info", "warning", "error", "critical"), F.lit(False))
    bad = blank("id") | blank("message") | ~known | (F.col("start_line") < 1) | (F.col("end_line") < 1) | (F.coalesce("schema_version", F.lit("")) != CONTRACT_VERSION)
    return _found(diagnostics.where(F.coalesce(bad, F.lit(False))), "diagnostics", "diagnostic schema", F.concat_ws(" ", "id", "file_path"))


def count_violations(summary: DataFrame, nodes: DataFrame, metrics: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Counts of the summary (long: run_id, name, n) that differ from the artifacts'."""
    kinds = nodes.where(F.col("kind").isin("project", "file", "type", "member")).groupBy(RUN, F.concat("kind", F.lit("_count")).alias("name")).agg(F.count("*").alias("actual"))
    rows = lambda df, name: df.groupBy(RUN).agg(F.count("*").alias("actual")).select(RUN, F.lit(name).alias("name"), "actual")
    actual = union_all([kinds, rows(metrics, "metric_result_count"), rows(diagnostics, "diagnostic_count")])
    both = summary.join(actual, [RUN, "name"], "left").where(F.col("n") != F.coalesce("actual", F.lit(0)))
    return _found(both, "summary", "count", F.concat_ws(" ", "name", F.col("n").cast("string")))


def violations(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, chunks: DataFrame, diagnostics: DataFrame, summary: DataFrame) -> DataFrame:
    """All violations of any number of runs."""
    return union_all(
        [
            node_violations(nodes), edge_violations(edges, nodes), metric_violations(metrics), chunk_violations(chunks), target_violations(metrics, nodes, "metrics"), target_violations(chunks, nodes, "chunks"),
            diagnostic_violations(diagnostics), count_violations(summary, nodes, metrics, diagnostics),
        ]
    )


