"""Projections of facts into metric rows: all 66 metrics of the catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.catalog import METRICS
from orefold.functions import scalar as fn
from orefold.operators import graph, intervals
from orefold.operators.relational import distinct_degrees, enriched, max_and_p95, union_all, with_known_ends
from orefold.plans.facts import RUN, Facts, only_trusted, project_memberships, unique_files

TARGET = (RUN, "target_kind", "target_id", "target_id_stability", "file_path", "start_line", "end_line")

LINE_COUNTERS = (
    "lines_of_code", "token_line_count", "blank_line_count", "comment_only_line_count", "commented_line_count", "mixed_code_comment_line_count", "documentation_comment_line_count",
)
LINE_RATIOS = {
    "token_line_ratio": "token_line_count", "blank_line_ratio": "blank_line_count", "comment_only_line_ratio": "comment_only_line_count", "commented_line_ratio": "commented_line_count",
    "documentation_comment_ratio": "documentation_comment_line_count",
}
DEPENDENCY_KINDS = ("inherits", "implements", "uses_type")


def _long(df: DataFrame, values: Mapping[str, Column], tags: Column | None = None) -> DataFrame:
    """One row per target and metric; null values are absent metrics."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric_id"), v.cast("double").alias("value")) for m, v in values.items()])
    none = F.lit(None).cast("array<string>")
    rows = df.select(*TARGET, (none if tags is None else tags).alias("tags"), F.inline(cells))
    return rows.where("value IS NOT NULL")


def _of_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("target_kind", F.lit(kind))


def _solutions(facts: Facts) -> DataFrame:
    return _scope(facts.health.select(RUN).distinct().withColumn("target_id", F.lit(fn.SOLUTION_ID)), "solution", F.lit("."))


def _projects(facts: Facts) -> DataFrame:
    rows = facts.projects.select(RUN, "project_path").distinct()
    keyed = rows.withColumn("project_key", fn.project_key(F.col("project_path"))).withColumn("target_id", fn.project_id(F.col("project_path")))
    return _scope(keyed, "project", F.col("project_path"))


def _scope(df: DataFrame, kind: str, path: Column) -> DataFrame:
    return df.withColumns({"target_kind": F.lit(kind), "target_id_stability": F.lit("syntax_fallback"), "file_path": path, "start_line": F.lit(1), "end_line": F.lit(1)})


def _ratio(a: str, b: str) -> Column:
    return F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0))


def _line_values() -> dict[str, Column]:
    return {c: F.col(c) for c in LINE_COUNTERS} | {r: _ratio(c, "lines_of_code") for r, c in LINE_RATIOS.items()}


def syntax_metrics(facts: Facts) -> DataFrame:
    """Lines, counts, complexities and their aggregates per member, type, file, project and solution.

    Sums over projects go through the file memberships, over the solution through distinct files; maxima and percentiles of an empty
    population are 0, ratios without denominator are absent.
    """
    files, members, types = unique_files(facts), facts.members, facts.types
    sums = [F.sum(c).alias(c) for c in LINE_COUNTERS]
    zero = lambda df: df.na.fill(0, list(LINE_COUNTERS))
    projects, solutions = _projects(facts), _solutions(facts)
    in_project = project_memberships(facts).join(files.drop("project_key"), [RUN, "file_path"]).groupBy(RUN, "project_key").agg(*sums)
    parts = [
        _long(_of_kind(files, "file"), _line_values()),
        _long(zero(projects.join(in_project, [RUN, "project_key"], "left")), _line_values()),
        _long(zero(solutions.join(files.groupBy(RUN).agg(*sums), RUN, "left")), _line_values()),
    ]
    flow = members.select(
        RUN, "target_id", "project_key", "parent_type_target_id", "file_path", "member_length", F.col("control_flow.cyclomatic_complexity").alias("member_cyclomatic_complexity"),
        F.col("control_flow.cognitive_complexity").alias("member_cognitive_complexity"), F.col("control_flow.nesting_depth").alias("member_nesting_depth"),
    ).dropDuplicates([RUN, "target_id"])
    measured = ["member_length", "member_cyclomatic_complexity", "member_cognitive_complexity", "member_nesting_depth"]
    names = [m for c in measured for m in (f"max_{c}", f"p95_{c}") if m != "p95_member_nesting_depth"]

    def with_members(targets: DataFrame, on: list[str], extra: Mapping[str, Column], more: DataFrame | None = None) -> DataFrame:
        agg = max_and_p95(flow, on, measured).join(flow.groupBy(*on).agg(F.count("*").alias("members"), F.sum("member_cyclomatic_complexity").alias("weight")), on)
        joined = targets.join(agg, on, "left")
        joined = joined if more is None else joined.join(more, on, "left")
        filled = joined.na.fill(0, [*names, "members", "weight", *([c for c in more.columns if c not in on] if more is not None else [])])
        return _long(filled, {m: F.col(m) for m in names} | dict(extra))

    spans = types.select(RUN, F.explode("declarations").alias("d")).select(RUN, "d.file_path", "d.start_line", "d.start_column").distinct()
    type_counts = spans.groupBy(RUN, "file_path").agg(F.count("*").alias("declared_types"))
    parts.append(with_members(_of_kind(files, "file"), [RUN, "file_path"], {"member_count": F.col("members"), "type_count": F.col("declared_types")}, type_counts))
    of_type = _of_kind(types, "type").withColumn("parent_type_target_id", F.col("target_id"))
    parts.append(with_members(of_type, [RUN, "parent_type_target_id"], {"weighted_member_complexity": F.col("weight")}))
    parts.append(_long(_of_kind(types, "type"), {c: F.col(c) for c in ("lines_of_code", "token_line_count", "member_count")}))
    sizes = types.select(RUN, "target_id", "project_key", F.col("lines_of_code").alias("type_lines_of_code")).dropDuplicates([RUN, "target_id"])
    largest = {m: F.col(m) for m in ("max_type_lines_of_code", "p95_type_lines_of_code")}
    parts.append(with_members(projects, [RUN, "project_key"], largest, max_and_p95(sizes, [RUN, "project_key"], ["type_lines_of_code"])))
    parts.append(with_members(solutions, [RUN], largest, max_and_p95(sizes, [RUN], ["type_lines_of_code"])))
    parts.append(
        _long(
            _of_kind(members, "member"),
            {"member_length": F.col("member_length"), "parameter_count": F.col("parameter_count")}
            | {m: F.col(f"control_flow.{m}") for m in ("cyclomatic_complexity", "decision_point_count", "cognitive_complexity", "nesting_depth")},
        )
    )
    return union_all(parts)


def duplication_metrics(facts: Facts) -> DataFrame:
    """Blocks, lines and line ratios per file, project and solution, and one tagged row per region."""
    files = unique_files(facts)
    regions = facts.regions
    lines = intervals.covered(regions.select(RUN, "file_path", "start_line", "end_line"), [RUN, "file_path"], "start_line", "end_line")
    per_file = files.join(regions.groupBy(RUN, "file_path").agg(F.count("*").alias("blocks")), [RUN, "file_path"], "left").join(lines, [RUN, "file_path"], "left").na.fill(0, ["blocks", "covered"])
    sums = [F.sum(c).alias(c) for c in ("blocks", "covered", "lines_of_code")]
    values = {"duplicated_block_count": F.col("blocks"), "duplicated_line_count": F.col("covered"), "duplicated_line_ratio": _ratio("covered", "lines_of_code")}
    fill = lambda df: df.na.fill(0, ["blocks", "covered", "lines_of_code"])
    in_project = project_memberships(facts).join(per_file.drop("project_key"), [RUN, "file_path"]).groupBy(RUN, "project_key").agg(*sums)
    tagged = regions.join(files.select(RUN, "file_path", "target_id", "target_id_stability"), [RUN, "file_path"])
    return union_all(
        [
            _long(_of_kind(per_file, "file"), values),
            _long(fill(_projects(facts).join(in_project, [RUN, "project_key"], "left")), values),
            _long(fill(_solutions(facts).join(per_file.groupBy(RUN).agg(*sums), RUN, "left")), values),
            _long(_of_kind(tagged, "file"), {"duplicated_block_count": F.lit(1)}, F.array("tag")),
        ]
    )


def type_dependencies(facts: Facts) -> DataFrame:
    """Distinct edges between types: a member's edge counts for its type, edges within a type and to others than types don't count."""
    edges = facts.edges.where(F.col("kind").isin(*DEPENDENCY_KINDS)).select(RUN, "from_id", "to_id").distinct()
    types = facts.types.select(RUN, F.col("target_id").alias("id")).distinct()
    owners = facts.members.select(RUN, F.col("target_id").alias("id"), F.col("parent_type_target_id").alias("owner")).unionByName(types.withColumn("owner", F.col("id"))).distinct()
    lifted = edges.join(owners.withColumnRenamed("id", "from_id"), [RUN, "from_id"]).select(RUN, F.col("owner").alias("from_id"), "to_id")
    both = with_known_ends(lifted.where("from_id <> to_id"), types, "id", keys=[RUN])
    return both.select(RUN, "from_id", "to_id").distinct()


def namespace_dependencies(facts: Facts) -> DataFrame:
    """Distinct edges between namespaces of which types of one depend on types of another."""
    of = facts.namespaces.select(RUN, "target_id", F.explode("type_target_ids").alias("t"))
    deps = type_dependencies(facts)
    up = deps.join(of.select(RUN, F.col("t").alias("from_id"), F.col("target_id").alias("a")), [RUN, "from_id"]).join(of.select(RUN, F.col("t").alias("to_id"), F.col("target_id").alias("b")), [RUN, "to_id"])
    return up.where("a <> b").select(RUN, F.col("a").alias("from_id"), F.col("b").alias("to_id")).distinct()


def _degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """fan_out and fan_in per run and node."""
    return distinct_degrees(edges, nodes, "target_id", keys=[RUN])


def _cycles(edges: DataFrame, nodes: DataFrame, reach: bool) -> DataFrame:
    g = graph.graph_measures(edges, nodes.select(RUN, F.col("target_id").alias("node")), [RUN], reach=reach)
    return g.select(RUN, F.col("node").alias("target_id"), "cyclic_size", "reachable", "dependents")


def graph_metrics(facts: Facts) -> DataFrame:
    """Dependencies, callers, cycles and reachability of trusted runs."""
    facts = only_trusted(facts)
    flag = (F.col("cyclic_size") > 0).cast("int")
    types, members = _of_kind(facts.types, "type"), _of_kind(facts.members, "member")
    deps = type_dependencies(facts)
    measured = _degrees(deps, types).join(_cycles(deps, types, True), [RUN, "target_id"])
    of_types = _long(
        measured,
        {
            "outgoing_type_dependency_count": F.col("fan_out"), "incoming_type_dependency_count": F.col("fan_in"), "dependency_cycle_membership": flag, "dependency_component_size": F.col("cyclic_size"),
            "transitive_type_dependency_count": F.col("reachable"), "transitive_type_dependent_count": F.col("dependents"),
        },
    )
    ids = members.select(RUN, "target_id").distinct()
    calls = facts.edges.where("kind = 'calls'").select(RUN, "from_id", "to_id").distinct()
    calls = with_known_ends(calls, ids, "target_id", keys=[RUN]).select(RUN, "from_id", "to_id")
    of_members = _long(
        _degrees(calls, members).join(_cycles(calls, members, False), [RUN, "target_id"]),
        {"distinct_outgoing_callee_count": F.col("fan_out"), "distinct_incoming_caller_count": F.col("fan_in"), "recursive_component_size": F.col("cyclic_size")},
    )
    owner = facts.members.select(RUN, "target_id", "parent_type_target_id").distinct()
    side = lambda end, other: calls.join(owner.withColumnRenamed("target_id", end), [RUN, end]).select(RUN, F.col("parent_type_target_id").alias("target_id"), other).distinct().groupBy(RUN, "target_id").agg(F.count("*").alias(f"by_{end}"))
    calling = types.join(side("from_id", "to_id"), [RUN, "target_id"], "left").join(side("to_id", "from_id"), [RUN, "target_id"], "left").na.fill(0, ["by_from_id", "by_to_id"])
    of_callers = _long(calling, {"distinct_outgoing_callee_count": F.col("by_from_id"), "distinct_incoming_caller_count": F.col("by_to_id")})

    analyzed = facts.projects.where("analyzed").select(RUN, "project_path").distinct()
    projects = _scope(analyzed.withColumn("target_id", fn.project_id(F.col("project_path"))), "project", F.col("project_path"))
    known = projects.select(RUN, "target_id")
    refs = facts.project_deps.select(RUN, fn.project_id(F.col("from_project_path")).alias("from_id"), fn.project_id(F.col("to_project_path")).alias("to_id")).distinct()
    refs = with_known_ends(refs, known, "target_id", keys=[RUN]).select(RUN, "from_id", "to_id")
    # a namespace's own row takes the place of its first declaration
    d = F.col("declarations")[0]
    namespaces = facts.namespaces.withColumns({"target_kind": F.lit("namespace"), "target_id_stability": F.lit("syntax_fallback"), "file_path": d["file_path"], "start_line": d["start_line"], "end_line": d["end_line"]})
    parts = [of_types, of_members, of_callers]
    for level, edges, nodes in (("project", refs, projects), ("namespace", namespace_dependencies(facts), namespaces)):
        parts.append(
            _long(
                _degrees(edges, nodes).join(_cycles(edges, nodes, False), [RUN, "target_id"]),
                {f"outgoing_{level}_dependency_count": F.col("fan_out"), f"incoming_{level}_dependency_count": F.col("fan_in"), f"{level}_dependency_cycle_membership": flag, f"{level}_dependency_component_size": F.col("cyclic_size")},
            )
        )
    return union_all(parts)


def semantic_metrics(facts: Facts) -> DataFrame:
    """Inheritance, coupling, public API and operations of trusted runs, from the ingested structs; a null struct is absent metrics."""
    facts = only_trusted(facts)
    types = _of_kind(facts.types.where("semantic IS NOT NULL"), "type").select("*", *[F.col(f"semantic.{c}").alias(c) for c in ("inheritance_depth", "class_coupling", "public_api_count", "documented_public_api_count")])
    api = {"public_api_count": F.col("public_api_count"), "documented_public_api_count": F.col("documented_public_api_count"), "public_api_documentation_ratio": _ratio("documented_public_api_count", "public_api_count")}
    per_project = types.groupBy(RUN, "project_key").agg(F.sum("public_api_count").alias("public_api_count"), F.sum("documented_public_api_count").alias("documented_public_api_count"))
    projects = _projects(facts).join(per_project, [RUN, "project_key"], "left").na.fill(0, ["public_api_count", "documented_public_api_count"])
    ops = ("operation_count", "allocation_count", "await_count", "control_flow_graph_count", "basic_block_count", "reachable_basic_block_count", "unreachable_basic_block_count", "control_flow_edge_count")
    o = lambda c: F.col(f"operations.{c}")
    cfg = F.when(o("control_flow_graph_count") > 0, F.greatest(F.lit(1), o("control_flow_edge_count") - o("basic_block_count") + 2 * o("control_flow_graph_count")))
    return union_all(
        [
            _long(types, {"inheritance_depth": F.col("inheritance_depth"), "type_coupling": F.col("class_coupling")} | api),
            _long(projects, api),
            _long(_of_kind(facts.members.where("operations IS NOT NULL"), "member"), {c: o(c) for c in ops} | {"cfg_cyclomatic_complexity": cfg}),
        ]
    )


def diagnostic_metrics(facts: Facts) -> DataFrame:
    """Diagnostics that overlap any declaration of a file, type or member, each once, in total and per tag, of runs with trusted diagnostics."""
    runs = facts.health.where("trusted_diagnostics").select(RUN).distinct()
    files = _of_kind(unique_files(facts), "file").withColumn("spans", F.array(F.struct("file_path", "start_line", "end_line")))
    spans = lambda df: F.when(F.size("declarations") > 0, F.transform("declarations", lambda d: F.struct(d["file_path"].alias("file_path"), d["start_line"].alias("start_line"), d["end_line"].alias("end_line")))).otherwise(F.array(F.struct("file_path", "start_line", "end_line")))
    typed = lambda df, kind: _of_kind(df, kind).withColumn("spans", spans(df))
    targets = union_all([df.select(*TARGET, "spans") for df in (files, typed(facts.types, "type"), typed(facts.members, "member"))]).join(runs, RUN, "left_semi")
    each = targets.select(*TARGET, F.explode("spans").alias("s")).select(*TARGET, F.col("s.file_path").alias("path"), F.col("s.start_line").alias("start"), F.col("s.end_line").alias("end"))
    marks = facts.diagnostics.select(RUN, F.col("file_path").alias("path"), "diag_id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    total = intervals.overlap_counts(each, list(TARGET), marks, "diag_id", [RUN, "path"])
    tags = facts.diagnostics.select(RUN, F.col("file_path").alias("path"), "diag_id", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.explode(F.array_distinct("tags")).alias("tag"))
    by_tag = intervals.overlap_counts(each.join(tags.select(RUN, "path", "tag").distinct(), [RUN, "path"]), [*TARGET, "tag"], tags, "diag_id", [RUN, "path", "tag"])
    return union_all([_long(total, {"diagnostic_count": F.col("n")}), _long(by_tag.where("n > 0"), {"diagnostic_count": F.col("n")}, F.array("tag"))])


def all_metrics(facts: Facts) -> DataFrame:
    """Metric rows of every family but the ranking, with run_id and the columns of schemas.METRICS.

    Families that no run is trusted for aren't planned at all.
    """
    parts = [syntax_metrics(facts), duplication_metrics(facts)]
    gate = facts.health.agg(F.bool_or(F.col("analysis_quality") == "trusted").alias("semantic"), F.bool_or("trusted_diagnostics").alias("diagnostics")).first()
    if gate.semantic:
        parts += [graph_metrics(facts), semantic_metrics(facts)]
    if gate.diagnostics:
        parts.append(diagnostic_metrics(facts))
    return observations(union_all(parts))


def observations(long: DataFrame) -> DataFrame:
    return enriched(long, [RUN])


def trusted_metric_ids() -> set[str]:
    return {m.id for m in METRICS if m.needs == "trusted"}
