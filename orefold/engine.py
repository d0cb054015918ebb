"""The engine's entry points: analyse, rank, report, validate, score."""

from __future__ import annotations

import shutil
import tempfile
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators.relational import union_all
from orefold.plans import contracts, hotspots, reporting, scoring, validate
from orefold.plans.facts import RUN, Facts, collect_facts
from orefold.plans.metrics import all_metrics
from orefold.runtime import materialize
from orefold.sources import artifacts, trees


class Engine:
    """Plans over a Spark session; everything stays lazy but sinks, distributed sorts and graph measures."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def facts_of_tree(self, path: str, include: list[str] | None = None, exclude: list[str] | None = None, generated: bool = False) -> Facts:
        """Syntax-only facts of a directory, project or solution."""
        kind, root, projects = trees.select_input(path)
        sources = trees.read_sources(self.spark, str(root), include=include, exclude=exclude, generated=generated)
        known = trees.read_projects(self.spark, str(root))
        collected = collect_facts(self.spark, sources, known, root_path=str(root))
        ambient = [f"build file outside the analysed root may change what a build sees: {f}" for f in trees.ambient_files(root)]
        health = collected.health.withColumn("messages", F.concat("messages", F.array(*map(F.lit, ambient)).cast("array<string>")))
        references = trees.read_project_references(self.spark, str(root)).withColumn(RUN, F.lit("run"))
        references = references.join(collected.projects.select(F.col("project_path").alias("to_project_path")), "to_project_path", "left_semi")
        facts = replace(collected, root_path=str(root), health=health, project_deps=references.select(RUN, "from_project_path", "to_project_path").distinct())
        if kind == "directory":
            return facts
        from orefold.functions.scalar import project_key

        chosen = self.spark.createDataFrame([(str(p.relative_to(root)),) for p in projects], "project_path string")
        keys = F.broadcast(chosen.select(project_key(F.col("project_path")).alias("project_key")))  # the input's own projects
        keep = lambda df: df.join(keys, "project_key", "left_semi")
        files = keep(facts.files)
        paths = files.select(RUN, "file_path").distinct()
        inside = lambda df: df.join(paths, [RUN, "file_path"], "left_semi")
        return replace(facts, files=files, types=keep(facts.types), members=keep(facts.members), namespaces=keep(facts.namespaces), memberships=keep(facts.memberships), projects=facts.projects.join(chosen, "project_path", "left_semi"), project_deps=facts.project_deps.join(chosen.withColumnRenamed("project_path", "from_project_path"), "from_project_path", "left_semi"), regions=inside(facts.regions), sources=inside(facts.sources))

    def analyze(self, facts: Facts) -> DataFrame:
        """All metric rows but the ranking's."""
        return all_metrics(facts)

    def rank(self, facts: Facts, metrics: DataFrame, top: int = hotspots.TOP) -> tuple[DataFrame, DataFrame]:
        """(top hotspots, hotspot_rank rows)."""
        ranked = hotspots.rank(hotspots.candidates(facts), metrics, facts.health)
        return hotspots.top_hotspots(ranked, top), hotspots.rank_metrics(ranked)

    def run(self, path: str, out: str, top: int = hotspots.TOP, include_text: bool = False, isolate: bool = False, no_restore: bool = False, **options) -> dict:
        """Analyse a tree and publish its artifacts: staged beside the output, validated, then put in place.

        isolate: a private copy of the tree is read, without its links and excluded directories. no_restore is only noted, as nothing is ever restored.
        """
        reporting.check_output(out, path)
        kind, root, _ = trees.select_input(path)
        chosen = {"kind": kind} | ({} if kind == "directory" else {"selectedPath": Path(path).resolve().relative_to(root).as_posix()})
        noted = {"includePatterns": options.get("include") or [], "excludePatterns": options.get("exclude") or [], "includeGeneratedCode": bool(options.get("generated")), "includeChunkText": include_text, "syntaxOnly": True, "noRestore": no_restore, "isolateInput": isolate, "top": top}
        if not isolate:
            return self._run(path, out, top, include_text, chosen | {"options": noted}, str(root), **options)
        with tempfile.TemporaryDirectory(prefix="orefold-input-") as private:
            copy = Path(trees.isolated_copy(str(root), f"{private}/tree"))
            inside = copy / Path(path).resolve().relative_to(root)
            return self._run(str(inside), out, top, include_text, chosen | {"options": noted}, str(root), **options)

    def _run(self, path: str, out: str, top: int, include_text: bool, chosen: dict, root: str, **options) -> dict:
        started = time.time()
        facts = replace(self.facts_of_tree(path, **options), root_path=root)
        metrics = materialize(self.analyze(facts), "metrics")
        best, ranks = self.rank(facts, metrics, top)
        every = materialize(union_all([metrics, ranks]), "observations")
        Path(out).resolve().parent.mkdir(parents=True, exist_ok=True)
        stage = tempfile.mkdtemp(prefix=".stage-", dir=Path(out).resolve().parent)
        try:
            reporting.write_artifacts(f"{stage}/run", "run", facts, every, best, chosen, started, include_text)
            problems = self.validate(f"{stage}/run").limit(20).collect()
            if problems:
                raise ValueError(f"the artifacts aren't valid: {problems}")
            reporting.publish(f"{stage}/run", out)
        finally:
            shutil.rmtree(stage, ignore_errors=True)
        return artifacts.read_document(self.spark, f"{out}/summary.json")

    def accepted(self, summary: dict, allow_degraded: bool = False, allow_empty: bool = False) -> bool:
        """Whether a run may pass: not empty unless that is allowed, and trusted or syntax-only unless degraded ones are allowed."""
        quality = summary["analysisHealth"]["analysisQuality"]
        return (allow_empty or summary["fileCount"] > 0) and (allow_degraded or quality in ("trusted", "syntax_only"))

    def validate(self, folder: str) -> DataFrame:
        """Violations of the artifacts in a folder: artifact, rule, detail."""
        for name in reporting.FILES:
            if not Path(folder, name).is_file():
                raise ValueError(f"{folder} lacks {name}")
        run = lambda df: df.withColumn(RUN, F.lit("run"))
        manifest, summary = (artifacts.read_document(self.spark, f"{folder}/{n}") for n in ("manifest.json", "summary.json"))
        problems = [("manifest", "schema", p) for p in contracts.manifest_problems(manifest)] + [("summary", "schema", p) for p in contracts.problems(summary, contracts.SUMMARY, "summary")]
        if summary.get("schemaVersion") != manifest.get("schemaVersion"):
            problems.append(("summary", "schema version", str(summary.get("schemaVersion"))))
        if summary.get("rootPath") != manifest.get("rootPath"):
            problems.append(("summary", "root path", str(summary.get("rootPath"))))
        nodes, edges = artifacts.read_graph(self.spark, f"{folder}/graph.json")
        counts = [("run", snake, int(summary.get(reporting.camel(snake), -1))) for snake in ("project_count", "file_count", "type_count", "member_count", "metric_result_count", "diagnostic_count")]
        found = validate.violations(
            run(nodes), run(edges), run(artifacts.read_metrics(self.spark, f"{folder}/metrics.ndjson")), run(artifacts.read_chunks(self.spark, f"{folder}/chunks.ndjson")), run(artifacts.read_diagnostics(self.spark, f"{folder}/diagnostics.ndjson")),
            self.spark.createDataFrame(counts, f"{RUN} string, name string, n bigint"),
        ).drop(RUN)
        return found.unionByName(self.spark.createDataFrame(problems, "artifact string, rule string, detail string"))

    def score(self, folder: str, profile: str) -> dict:
        """Evaluate a profile's text over the artifacts in a folder; an error if they change meanwhile."""
        if len(profile.encode()) > scoring.MAX_PROFILE:
            raise scoring.InvalidProfile(f"the profile has more than {scoring.MAX_PROFILE} bytes")
        parsed = scoring.parse_profile(profile)
        before = sorted(map(tuple, artifacts.content_hash(self.spark, folder).collect()))
        manifest, summary = (artifacts.read_document(self.spark, f"{folder}/{n}") for n in ("manifest.json", "summary.json"))
        if summary.get("schemaVersion") != reporting.CONTRACT_VERSION:
            raise scoring.InvalidArtifacts(f"summary has schema version {summary.get('schemaVersion')}")
        health = {"analysis_quality": summary["analysisHealth"]["analysisQuality"], "trusted_diagnostics": summary["analysisHealth"]["trustedDiagnostics"]}
        nodes, _ = artifacts.read_graph(self.spark, f"{folder}/graph.json")
        result = scoring.evaluate(parsed, artifacts.read_metrics(self.spark, f"{folder}/metrics.ndjson"), nodes, health, manifest["mode"])
        if sorted(map(tuple, artifacts.content_hash(self.spark, folder).collect())) != before:
            raise scoring.InvalidArtifacts("the artifacts changed while they were read")
        return result | {"snapshot": dict(before)}
