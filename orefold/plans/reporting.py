"""Artifacts of a run: graph, chunks, summary and manifest, as DataFrames and as files."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.catalog import CONTRACT_VERSION
from orefold.functions import scalar as fn
from orefold.operators.relational import union_all
from orefold.plans.facts import RUN, Facts, project_memberships, unique_files

FILES = ("summary.json", "metrics.ndjson", "graph.json", "chunks.ndjson", "diagnostics.ndjson", "manifest.json")
#: Edges or diagnostics of one run that its artifacts hold; more are an error, never cut. A fixed value.
MAX_RECORDS = 1_000_000
KIND_ORDER = ("solution", "project", "namespace", "file", "type", "member")


def graph_nodes(facts: Facts) -> DataFrame:
    """All targets with kind, name, place and declarations; kind_order and id give the canonical order."""
    place = F.array(F.struct(F.col("file_path"), F.col("start_line"), F.col("end_line")))
    spans = F.transform("declarations", lambda d: F.struct(d["file_path"].alias("file_path"), d["start_line"].alias("start_line"), d["end_line"].alias("end_line")))
    none = F.lit(None).cast("array<struct<file_path:string,start_line:int,end_line:int>>")

    def node(df, kind, key, name, stability, path, first, last, declarations):
        return df.select(RUN, key.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), stability.alias("target_id_stability"), path.alias("file_path"), first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), declarations.alias("declarations"))

    fallback, one, c = F.lit("syntax_fallback"), F.lit(1), F.col
    project = F.when(c("project_path") == ".", "source-tree").otherwise(fn.stem(c("project_path")))
    d = F.col("declarations")[0]
    parts = [
        node(facts.health.select(RUN).distinct(), "solution", F.lit(fn.SOLUTION_ID), F.lit("analysis-root"), fallback, F.lit("."), one, one, none),
        node(facts.projects.select(RUN, "project_path").distinct(), "project", fn.project_id(c("project_path")), project, fallback, c("project_path"), one, one, none),
        node(facts.namespaces, "namespace", c("target_id"), c("name"), fallback, d["file_path"], d["start_line"], d["end_line"], spans),
        node(unique_files(facts), "file", c("target_id"), fn.file_name(c("file_path")), c("target_id_stability"), c("file_path"), c("start_line"), c("end_line"), place),
        node(facts.types, "type", c("target_id"), c("name"), c("target_id_stability"), c("file_path"), c("start_line"), c("end_line"), spans),
        node(facts.members, "member", c("target_id"), c("name"), c("target_id_stability"), c("file_path"), c("start_line"), c("end_line"), spans),
    ]
    order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    return union_all(parts).withColumn("kind_order", order.cast("int"))


def graph_edges(facts: Facts) -> DataFrame:
    """Containment from the solution down to types, project references and the ingested edges, distinct."""
    edge = lambda df, a, b, kind: df.select(RUN, a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"), F.lit("exact").alias("confidence"))
    projects = facts.projects.select(RUN, "project_path").distinct()
    key = F.concat(F.lit("project:"), F.col("project_key"))
    known = projects.select(RUN, fn.project_key(F.col("project_path")).alias("project_key"))
    files = project_memberships(facts).join(unique_files(facts).select(RUN, "file_path", "target_id"), [RUN, "file_path"]).join(known, [RUN, "project_key"], "left_semi")
    parts = [
        edge(projects, F.lit(fn.SOLUTION_ID), fn.project_id(F.col("project_path")), "contains"),
        edge(files, key, F.col("target_id"), "contains"),
        edge(facts.namespaces, fn.project_id(F.col("project_path")), F.col("target_id"), "contains"),
        edge(facts.namespaces.select(RUN, "target_id", F.explode("type_target_ids").alias("t")), F.col("target_id"), F.col("t"), "contains"),
        edge(facts.project_deps, fn.project_id(F.col("from_project_path")), fn.project_id(F.col("to_project_path")), "depends_on"),
        facts.edges.select(RUN, "from_id", "to_id", "kind", "confidence"),
    ]
    return union_all(parts).distinct()


def chunks(facts: Facts, include_text: bool = True) -> DataFrame:
    """File headers, type declarations and member bodies with token estimate, hash and related targets."""
    files, types, members = unique_files(facts), facts.types, facts.members
    declared = types.select(RUN, "target_id", F.explode("declarations").alias("d")).select(RUN, F.col("d.file_path").alias("file_path"), F.col("target_id").alias("t"), F.col("d.start_line").alias("line"))
    by_file = declared.groupBy(RUN, "file_path").agg(F.min("line").alias("first"), F.array_sort(F.collect_set("t")).alias("related"))
    empty = F.array().cast("array<string>")
    heads = files.join(by_file, [RUN, "file_path"], "left").select(
        RUN, "target_id", F.lit("file").alias("target_kind"), "target_id_stability", F.lit("file_header").alias("chunk_kind"), "file_path", "start_line", F.lit(1).alias("start_column"),
        F.least("end_line", F.greatest("start_line", F.coalesce("first", F.col("end_line") + 1) - 1)).alias("end_line"), F.coalesce("related", empty).alias("related_target_ids"),
    )
    inside = members.groupBy(RUN, F.col("parent_type_target_id").alias("target_id")).agg(F.collect_set("target_id").alias("m"))
    targets = facts.edges.groupBy(RUN, F.col("from_id").alias("target_id")).agg(F.collect_set("to_id").alias("m"))

    def spans(df: DataFrame, kind: str, chunk_kind, other: DataFrame, parent: str) -> DataFrame:
        related = F.array_sort(F.array_distinct(F.concat(F.coalesce("m", empty), F.array(parent))))
        rows = df.join(other, [RUN, "target_id"], "left").select(RUN, "target_id", F.lit(kind).alias("target_kind"), "target_id_stability", chunk_kind.alias("chunk_kind"), related.alias("related_target_ids"), F.explode("declarations").alias("d"))
        return rows.select(RUN, "target_id", "target_kind", "target_id_stability", "chunk_kind", "d.file_path", "d.start_line", "d.start_column", "d.end_line", "related_target_ids")

    every = union_all([heads, spans(types, "type", F.lit("type_declaration"), inside, "parent_file_target_id"), spans(members, "member", F.col("chunk_kind"), targets, "parent_type_target_id")])
    cut = every.join(facts.sources.select(RUN, "file_path", F.col("text").alias("__source")), [RUN, "file_path"], "left")
    cut = cut.withColumn("__text", F.coalesce(fn.line_range(F.col("__source"), F.col("start_line"), F.col("end_line")), F.lit("")))
    return cut.select(
        RUN, F.lit(CONTRACT_VERSION).alias("schema_version"), fn.chunk_id(F.col("target_id"), F.col("chunk_kind"), F.col("file_path"), F.col("start_line"), F.col("start_column")).alias("chunk_id"), "target_id", "target_kind",
        "target_id_stability", "chunk_kind", "file_path", "start_line", "end_line", fn.token_estimate(F.col("__text")).alias("token_estimate"), fn.text_hash(F.col("__text")).alias("text_hash"), "related_target_ids",
        *([F.col("__text").alias("text")] if include_text else [F.lit(None).cast("string").alias("text")]),
    )


def analysis_mode(facts: Facts) -> DataFrame:
    """Mode per run by the stabilities of types and members: semantic, partial_semantic or syntax."""
    both = union_all([facts.types.select(RUN, "target_id_stability"), facts.members.select(RUN, "target_id_stability")])
    found = both.groupBy(RUN).agg(F.bool_or(F.col("target_id_stability") == "semantic").alias("s"), F.bool_or(F.col("target_id_stability") != "semantic").alias("o"))
    runs = facts.health.select(RUN).distinct().join(found, RUN, "left")
    return runs.select(RUN, F.when(F.col("s") & F.col("o"), "partial_semantic").when(F.col("s"), "semantic").otherwise("syntax").alias("mode"))


def summary(facts: Facts, metrics: DataFrame) -> DataFrame:
    """Counts per run."""
    count = lambda df, name: df.groupBy(RUN).agg(F.count("*").alias(name))
    parts = [
        count(facts.projects.select(RUN, "project_path").distinct(), "project_count"), count(facts.files.select(RUN, "file_path").distinct(), "file_count"), count(facts.types, "type_count"), count(facts.members, "member_count"),
        count(metrics, "metric_result_count"), count(facts.diagnostics, "diagnostic_count"),
    ]
    out = facts.health
    for p in parts:
        out = out.join(p, RUN, "left")
    return out.na.fill(0)


def population(facts: Facts) -> DataFrame:
    """source_population_sha256 per run."""
    from orefold.operators.relational import population_hash

    return population_hash(facts.files, [RUN], "file_path").select(RUN, F.concat(F.lit("sha256:"), "population_sha256").alias("source_population_sha256"))


# files


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(p.capitalize() for p in rest)


_WIRE = {"from_id": "from", "to_id": "to", "rank_no": "rank"}


def wire(df: DataFrame) -> DataFrame:
    """Columns under their wire names, nested ones too."""

    def kind(t):
        from pyspark.sql import types as T

        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(_WIRE.get(f.name, camel(f.name)), kind(f.dataType)) for f in t])
        return T.ArrayType(kind(t.elementType)) if isinstance(t, T.ArrayType) else t

    return df.select(*[F.col(f.name).cast(kind(f.dataType)).alias(_WIRE.get(f.name, camel(f.name))) for f in df.schema])


def write_ndjson(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object per line in a folder of text files, in order over the folder; nulls are left out."""
    df.sort(*order).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def _single_file(df: DataFrame, path: Path, order: list[str]) -> None:
    """The same as one file, for one run's artifacts: rows are streamed, not gathered."""
    _write_lines(df.sort(*order), path)


def write_artifacts(out: str, run: str, facts: Facts, metrics: DataFrame, hotspots: DataFrame, chosen: dict | None = None, started: float | None = None, include_text: bool = False) -> None:
    """The six files of one run in a new folder, the manifest last."""
    folder = Path(out)
    of = lambda df: df.where(F.col(RUN) == run).drop(RUN)
    for df, what in ((facts.edges, "edges"), (facts.diagnostics, "diagnostics")):
        if of(df).limit(MAX_RECORDS + 1).count() > MAX_RECORDS:
            raise ValueError(f"the run has more than {MAX_RECORDS} {what}")
    folder.mkdir(parents=True, exist_ok=False)
    started = started or time.time()
    counts = of(summary(facts, metrics)).first()
    health = {camel(k): counts[k] for k in ("analysis_quality", "semantic_model", "restore_status", "build_status", "trusted_diagnostics", "diagnostics_included_in_hotspot_rank", "messages")}
    top = [json.loads(r.value) for r in wire(of(hotspots).sort("rank_no")).select(F.to_json(F.struct("*")).alias("value")).collect()]
    numbers = {camel(k): counts[k] for k in ("project_count", "file_count", "type_count", "member_count", "metric_result_count", "diagnostic_count")}
    base = {"schemaVersion": CONTRACT_VERSION, "rootPath": facts.root_path}
    _json(folder / "summary.json", base | numbers | {"analysisHealth": health, "hotspots": top})
    _single_file(of(metrics), folder / "metrics.ndjson", ["metric_id", "target_id"])
    nodes = wire(of(graph_nodes(facts)).sort("kind_order", "id").drop("kind_order")).select(F.to_json(F.struct("*")).alias("v")).toLocalIterator()
    edges = wire(of(graph_edges(facts)).sort("from_id", "kind", "to_id")).select(F.to_json(F.struct("*")).alias("v")).toLocalIterator()
    with (folder / "graph.json").open("w", encoding="utf-8") as f:
        f.write(f'{{"schemaVersion":"{CONTRACT_VERSION}","nodes":[')
        f.writelines(("," if i else "") + r.v for i, r in enumerate(nodes))
        f.write('],"edges":[')
        f.writelines(("," if i else "") + r.v for i, r in enumerate(edges))
        f.write("]}\n")
    _single_file(of(chunks(facts, include_text)), folder / "chunks.ndjson", ["chunk_id"])
    last = F.lit(2147483647)
    ordered = of(facts.diagnostics).withColumns({"__p": F.coalesce("file_path", F.lit("")), "__l": F.coalesce("start_line", last), "__q": F.coalesce("project_path", F.lit(""))}).sort("__p", "__l", "id", "__q", "message").drop("__p", "__l", "__q", "diag_id").withColumn("schema_version", F.lit(CONTRACT_VERSION))
    _write_lines(ordered, folder / "diagnostics.ndjson")
    ended = time.time()
    stamp = lambda t: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(t))
    mode = of(analysis_mode(facts)).first()
    hashed = of(population(facts)).first()
    _json(
        folder / "manifest.json",
        {"schemaVersion": CONTRACT_VERSION, "tool": "orefold", "toolVersion": "0.1.0", "rootPath": facts.root_path, "startedAt": stamp(started), "completedAt": stamp(ended), "durationMs": max(0, int((ended - started) * 1000)), "mode": mode["mode"] if mode else "syntax",
         "input": {"kind": "directory", "options": {}} | (chosen or {}) | {"sourcePopulationSha256": hashed["source_population_sha256"] if hashed else f"sha256:{hashlib.sha256().hexdigest()}"}, "artifacts": {n.split(".")[0]: n for n in FILES if n != "manifest.json"}},
    )


def _write_lines(df: DataFrame, path: Path) -> None:
    with path.open("w", encoding="utf-8") as f:
        f.writelines(r.value + "\n" for r in wire(df).select(F.to_json(F.struct("*")).alias("value")).toLocalIterator())


def _json(path: Path, value: dict) -> None:
    path.write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def check_output(out: str, source: str) -> None:
    """The output may be neither the input nor contain it; links are followed."""
    a, b = os.path.realpath(out), os.path.realpath(source)
    if b == a or b.startswith(a + os.sep):
        raise ValueError(f"the output {out} would overwrite the input {source}")


def publish(staged: str, final: str) -> None:
    """Put a finished folder in place of an empty one or of earlier artifacts; on failure the old one comes back."""
    target, backup = Path(final), Path(f"{final}.old-{os.getpid()}")
    if target.exists() and (not target.is_dir() or target.is_symlink() or {p.name for p in target.iterdir()} - set(FILES)):
        raise ValueError(f"{final} holds something else than artifacts")
    if target.exists():
        os.replace(target, backup)
    try:
        os.replace(staged, target)
    except OSError:
        if backup.exists():
            os.replace(backup, target)
        raise
    shutil.rmtree(backup, ignore_errors=True)
