"""Fact tables of one or many analysis runs, and their collection from source text.

Every table has a run_id, so the metrics of any number of runs come from one plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold import schemas
from orefold.frontend.declarations import parse_file
from orefold.frontend.lexer import duplication_tokens
from orefold.functions import scalar as fn
from orefold.operators import duplication
from orefold.operators.relational import first_per_group, longest_prefix
from orefold.runtime import materialize

RUN = "run_id"


@dataclass(frozen=True)
class Facts:
    """The fact tables; health has one row per run. Missing tables are empty."""

    files: DataFrame
    types: DataFrame
    members: DataFrame
    namespaces: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    projects: DataFrame
    project_deps: DataFrame
    memberships: DataFrame
    regions: DataFrame
    sources: DataFrame
    health: DataFrame
    root_path: str = "."
    options: dict = field(default_factory=dict)


def empty_facts(spark: SparkSession, **tables: DataFrame) -> Facts:
    """Facts with the given tables and empty ones for the rest; a table without run_id gets the run 'run'."""
    blank = {name: spark.createDataFrame([], f"{RUN} string, {ddl}") for name, ddl in {**schemas.FACTS, "health": schemas.HEALTH}.items()}
    given = {name: df if RUN in df.columns else df.withColumn(RUN, F.lit("run")) for name, df in tables.items()}
    return Facts(**{**blank, **given})


def trusted(facts: Facts) -> DataFrame:
    """Runs whose semantic facts may be used."""
    return facts.health.where("analysis_quality = 'trusted'").select(RUN).distinct()


def only_trusted(facts: Facts) -> Facts:
    """The gate of the semantic projections: tables without the rows of untrusted runs."""
    runs = trusted(facts)
    keep = lambda df: df.join(runs, RUN, "left_semi")
    return replace(facts, **{name: keep(getattr(facts, name)) for name in schemas.FACTS})


_PARSED = (
    "lines struct<lines_of_code:int,token_line_count:int,blank_line_count:int,comment_only_line_count:int,commented_line_count:int,mixed_code_comment_line_count:int,documentation_comment_line_count:int>, "
    "types array<struct<n:int,name:string,qualified:string,namespace:string,start_line:int,end_line:int,start_column:int,token_lines:int>>, "
    "members array<struct<n:int,name:string,kind:string,start_line:int,end_line:int,start_column:int,parameter_count:int,has_body:boolean,"
    "control_flow:struct<cyclomatic_complexity:int,decision_point_count:int,cognitive_complexity:int,nesting_depth:int>>>"
)


def parse_sources(sources: DataFrame) -> DataFrame:
    """sources (run_id, project_key, file_path, text, ...) with the lines, types and members of each file; a null text parses as empty."""
    kept = [c for c in sources.columns if c != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse_file(t or "") for t in pdf["text"]]
            out = pdf[kept].copy()
            out["lines"] = [p.lines for p in parsed]
            out["types"] = [[{"n": i, "name": t.name, "qualified": t.qualified, "namespace": t.namespace, "start_line": t.start_line, "end_line": t.end_line, "start_column": t.start_column, "token_lines": t.token_lines} for i, t in enumerate(p.types)] for p in parsed]
            out["members"] = [
                [
                    {"n": i, "name": m.name, "kind": m.kind, "start_line": m.start_line, "end_line": m.end_line, "start_column": m.start_column, "parameter_count": m.parameter_count, "has_body": m.has_body, "control_flow": m.flow}
                    for i, t in enumerate(p.types)
                    for m in t.members
                ]
                for p in parsed
            ]
            yield out

    return sources.mapInPandas(run, f"{ddl}, {_PARSED}")


def assign_projects(sources: DataFrame, projects: DataFrame, root_path: str = ".") -> DataFrame:
    """Files with the project file whose directory is the nearest above them: project_path and project_key.

    Without any project the synthetic one '.' takes all files; files outside of every project fall back to the root path.
    Of projects in one directory the first by path wins.
    """
    dirs = projects.select("project_path", fn.directory(F.col("project_path")).alias("__dir")).groupBy("__dir").agg(F.min("project_path").alias("project_path"))
    near = longest_prefix(sources, "file_path", dirs, "__dir").join(dirs, "__dir", "left").drop("__dir")
    fallback = F.lit("." if projects.limit(1).count() == 0 else root_path)
    path = F.coalesce("project_path", fallback)
    return near.withColumn("project_path", path).withColumn("project_key", fn.project_key(path))


def collect_facts(spark: SparkSession, sources: DataFrame, projects: DataFrame | None = None, root_path: str = ".", min_tokens: int = duplication.MIN_TOKENS, min_lines: int = duplication.MIN_LINES) -> Facts:
    """Facts of source text alone, as a syntax-only run: fallback identities, no edges, no diagnostics.

    sources: file_path, text and optionally run_id. projects: project_path. Facts that need symbol binding are ingested, not made up (see README).
    """
    if RUN not in sources.columns:
        sources = sources.withColumn(RUN, F.lit("run"))
    if projects is None:
        projects = spark.createDataFrame([], "project_path string")
    placed = assign_projects(sources.select(RUN, "file_path", "text"), projects, root_path)
    parsed = materialize(parse_sources(placed), "parsed")  # every table below comes from it; files are lexed once
    files = parsed.select(
        RUN, F.lit(0).cast("bigint").alias("seq"), fn.file_id(F.col("file_path")).alias("target_id"), F.lit("syntax_fallback").alias("target_id_stability"), "project_key", "file_path",
        F.lit(1).alias("start_line"), F.col("lines.lines_of_code").alias("end_line"), "lines.*",
    )
    key, path = F.col("project_key"), F.col("file_path")
    span = lambda: F.struct(path.alias("file_path"), "start_line", "start_column", "end_line")
    raw = parsed.select(RUN, "project_key", "project_path", "file_path", F.explode("types").alias("t")).select(RUN, "project_key", "project_path", "file_path", "t.*")
    raw = raw.withColumn("target_id", fn.fallback_type_id(key, F.col("qualified"), path))
    raw_members = (
        parsed.select(RUN, "project_key", "file_path", "types", F.explode("members").alias("m"))
        .select(RUN, "project_key", "file_path", F.col("types")[F.col("m.n")]["qualified"].alias("owner"), "m.*")
        .withColumn("parent_type_target_id", fn.fallback_type_id(key, F.col("owner"), path))
        .withColumn("target_id", fn.fallback_member_id(key, F.col("owner"), F.col("name"), F.col("parameter_count"), path, F.col("start_line")))
    )
    members = materialize(merge_members(raw_members.withColumn("span", span())), "members")
    types = materialize(merge_types(raw.withColumn("span", span()), members), "types")
    namespaces = raw.groupBy(RUN, "project_key", "project_path", "namespace").agg(F.array_sort(F.collect_set("target_id")).alias("type_target_ids"), F.array_sort(F.collect_list(span())).alias("declarations"))
    namespaces = namespaces.select(RUN, fn.namespace_id(key, F.col("namespace")).alias("target_id"), "project_key", "project_path", F.when(F.col("namespace") == "", "(global)").otherwise(F.col("namespace")).alias("name"), "type_target_ids", "declarations")
    windows = duplication.token_windows(sources.select(F.concat_ws("\0", RUN, "file_path").alias("file"), "text"), "file", "text", duplication_tokens, min_tokens, min_lines)
    regions = duplication.with_tags(duplication.duplicated_regions(duplication.repeated_windows(windows, min_tokens), min_tokens))
    parts = F.split("file", "\0")
    regions = materialize(regions.select(parts[0].alias(RUN), parts[1].alias("file_path"), "start_line", "end_line", "tag"), "regions")
    found = parsed.select(RUN, "project_path").distinct().select(RUN, "project_path", F.lit(True).alias("analyzed"))
    health = parsed.select(RUN).distinct().select(
        RUN, F.lit("syntax_only").alias("analysis_quality"), F.lit("none").alias("semantic_model"), F.lit("not_run").alias("restore_status"), F.lit("not_run").alias("build_status"),
        F.lit(False).alias("trusted_diagnostics"), F.lit(False).alias("diagnostics_included_in_hotspot_rank"), F.array().cast("array<string>").alias("messages"),
    )
    return empty_facts(spark, files=files, types=types, members=members, namespaces=namespaces, projects=found, memberships=parsed.select(RUN, "project_key", "file_path").distinct(), regions=regions, sources=sources.select(RUN, "file_path", "text"), health=health)


def merge_members(rows: DataFrame) -> DataFrame:
    """Declarations of one member as one fact: the one with a body comes first, then by path and line; spans are gathered."""
    order = F.struct((~F.col("has_body")).alias("a"), F.col("file_path").alias("b"), F.col("start_line").alias("c"))
    first = F.min_by(F.struct("project_key", "parent_type_target_id", "owner", "name", "kind", "file_path", "start_line", "end_line", "control_flow", "parameter_count"), order).alias("f")
    merged = rows.groupBy(RUN, "target_id").agg(first, F.array_sort(F.collect_list("span")).alias("declarations"))
    return merged.select(
        RUN, "target_id", F.lit("line_fallback").alias("target_id_stability"), "f.parent_type_target_id", "f.project_key", F.concat_ws(".", "f.owner", "f.name").alias("name"), F.col("f.kind").alias("chunk_kind"), "f.file_path",
        "f.start_line", "f.end_line", "declarations", "f.control_flow", F.greatest(F.lit(1), F.col("f.end_line") - F.col("f.start_line") + 1).alias("member_length"), "f.parameter_count",
        F.lit(None).cast("struct<operation_count:int,allocation_count:int,await_count:int,control_flow_graph_count:int,basic_block_count:int,reachable_basic_block_count:int,unreachable_basic_block_count:int,control_flow_edge_count:int,cfg_cyclomatic_complexity:int>").alias("operations"),
    )


def merge_types(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Partial declarations of one type as one fact: lines are summed, the first by path and line names it."""
    first = F.min_by(F.struct("project_key", "qualified", "file_path", "start_line", "end_line"), F.struct("file_path", "start_line")).alias("f")
    merged = rows.groupBy(RUN, "target_id").agg(
        first, F.array_sort(F.collect_list("span")).alias("declarations"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("int").alias("lines_of_code"), F.sum("token_lines").cast("int").alias("token_line_count")
    )
    counts = members.groupBy(RUN, F.col("parent_type_target_id").alias("target_id")).agg(F.count("*").cast("int").alias("member_count"))
    return merged.join(counts, [RUN, "target_id"], "left").select(
        RUN, "target_id", F.lit("syntax_fallback").alias("target_id_stability"), fn.file_id(F.col("f.file_path")).alias("parent_file_target_id"), "f.project_key", F.col("f.qualified").alias("name"), "f.file_path", "f.start_line",
        "f.end_line", "declarations", "lines_of_code", "token_line_count", F.coalesce("member_count", F.lit(0)).alias("member_count"),
        F.lit(None).cast("struct<inheritance_depth:int,class_coupling:int,public_api_count:int,documented_public_api_count:int>").alias("semantic"),
    )


def unique_files(facts: Facts) -> DataFrame:
    """One row per run and path, the first in encounter order."""
    return first_per_group(facts.files, [RUN, "file_path"], ["seq", "target_id"])


def project_memberships(facts: Facts) -> DataFrame:
    """The given memberships, or those of the files of runs that give none."""
    given = facts.memberships.select(RUN, "project_key", "file_path").distinct()
    derived = facts.files.select(RUN, "project_key", "file_path").distinct().join(given.select(RUN).distinct(), RUN, "left_anti")
    return given.unionByName(derived)
