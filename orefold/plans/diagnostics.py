"""Ingested diagnostics and health made fit for the projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions.scalar import diagnostic_tags
from orefold.operators.relational import merged_tags
from orefold.plans.facts import RUN

KEY = (RUN, "id", "project_path", "file_path", "start_line", "end_line", "message")


def severity(raw: Column) -> Column:
    """info, warning or error from a compiler's severity; anything else counts as a warning."""
    return F.when(F.lower(raw).isin("hidden", "info"), "info").when(F.lower(raw) == "error", "error").otherwise("warning")


def normalise(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Reported diagnostics (run_id, id, severity, message, project_path, file_path, start_line, end_line, and tags if known) as facts.

    Those of synthetic usings and of files outside the population are left out, ones without a file stay; severities and, where missing, tags are derived;
    reports that differ in tags alone become one with all of them. diag_id tells them apart within a run.
    """
    rows = raw if "tags" in raw.columns else raw.withColumn("tags", F.lit(None).cast("array<string>"))
    rows = rows.where(F.col("file_path").isNull() | ~F.col("file_path").endswith(".ImplicitUsings.g.cs"))
    known = files.select(RUN, "file_path").distinct()
    inside = rows.where("file_path IS NOT NULL").join(known, [RUN, "file_path"], "left_semi")
    rows = rows.where("file_path IS NULL").unionByName(inside.select(*rows.columns))
    rows = rows.withColumns({"severity": severity(F.col("severity")), "tags": F.coalesce("tags", diagnostic_tags(F.col("id")))})
    merged = merged_tags(rows, [*KEY, "severity"], "tags")
    return merged.withColumn("diag_id", F.xxhash64(*KEY, "severity"))


def reclassify(failures: DataFrame, reported: DataFrame) -> DataFrame:
    """Workspace failures that are a project's build warning, flattened: kind becomes warning where a warning and no error of the build log matches.

    failures: run_id, kind, message; reported (the build log): run_id, level, project, text. Both are a few rows of one run, so they are matched within it.
    """
    log = reported.where("project <> '' AND text <> ''").select(RUN, "level", "project", "text")
    one = failures.withColumn("__n", F.monotonically_increasing_id())
    hits = one.join(log, RUN).where(F.contains("message", "project") & F.endswith("message", F.concat(F.lit(": "), "text")))
    seen = hits.groupBy("__n").agg(F.bool_or(F.col("level") == "warning").alias("w"), F.bool_or(F.col("level") == "error").alias("e"))
    flip = (F.col("kind") == "failure") & F.coalesce(F.col("w") & ~F.col("e"), F.lit(False))
    return one.join(seen, "__n", "left").withColumn("kind", F.when(flip, "warning").otherwise(F.col("kind"))).drop("__n", "w", "e")


def health(loads: DataFrame) -> DataFrame:
    """One health row per run from its load: run_id, used_semantic, trust_diagnostics, initialization_failure, semantic_model, restore_status, messages."""
    semantic, failed, trust = F.col("used_semantic"), F.col("initialization_failure").isNotNull(), F.col("trust_diagnostics")
    quality = F.when(semantic & trust, "trusted").when(semantic | failed, "degraded").otherwise("syntax_only")
    model = F.when(semantic, F.col("semantic_model")).when(failed, "not_available").otherwise("none")
    return loads.select(
        RUN, quality.alias("analysis_quality"), model.alias("semantic_model"), F.when(semantic, F.col("restore_status")).otherwise("not_run").alias("restore_status"), F.lit("not_run").alias("build_status"),
        (semantic & trust).alias("trusted_diagnostics"), (semantic & trust).alias("diagnostics_included_in_hotspot_rank"), "messages",
    )
