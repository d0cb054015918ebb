import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from orefold import cli, schemas
from orefold.engine import Engine
from orefold.operators.relational import union_all
from orefold.plans import contracts, diagnostics, hotspots, reporting, scoring, validate
from orefold.plans.facts import RUN, collect_facts, empty_facts
from orefold.plans.metrics import all_metrics

SPAN = lambda p, a, b: (p, a, 1, b)
HEALTH = [("trusted", "msbuild", "success", "not_run", True, True, ["ok"])]


def trusted_facts(spark, health=HEALTH):
    """Types A..F with A<->B, A->C, B->D, C->E, D->E; one member per type that calls the next."""
    df = lambda data, ddl: spark.createDataFrame(data, ddl)
    names = "ABCDEF"
    key = hashlib.sha256(b"p.csproj").hexdigest()[:16]
    files = [(n, f"file:{x}.cs", "syntax_fallback", key, f"{x}.cs", 1, 20, 20, 15, 2, 2, 3, 1, 1) for n, x in enumerate(names)] + [(9, "file:A.cs", "syntax_fallback", "other", "A.cs", 1, 20, 99, 1, 1, 1, 1, 1, 1)]
    types = [(f"type:{x}", "semantic", f"file:{x}.cs", key, x, f"{x}.cs", 1, 20, [SPAN(f"{x}.cs", 1, 20)], 20, 15, 1, (1, 2, 4, n) if n else None) for n, x in enumerate(names)]
    members = [(f"member:{x}", "semantic", f"type:{x}", key, f"{x}.M", "member_body", f"{x}.cs", 2, 2 + n, [SPAN(f"{x}.cs", 2, 2 + n)], (n + 1, n, n, 0), n + 1, n, (5, 1, 0, 1, 4, 4, 0, 3, 1) if n else None) for n, x in enumerate(names)]
    spaces = [("namespace:k/N:One", key, "p.csproj", "One", ["type:A", "type:B", "type:C"], [SPAN("A.cs", 1, 20)]), ("namespace:k/N:Two", key, "p.csproj", "Two", ["type:D", "type:E", "type:F"], [SPAN("D.cs", 1, 20)])]
    pairs = ["AB", "BA", "AC", "BD", "CE", "DE"]
    edges = [(f"type:{a}", f"type:{b}", "uses_type", "exact") for a, b in pairs] + [("member:A", "type:C", "uses_type", "exact"), ("type:A", "type:A", "inherits", "exact"), ("type:A", "type:Gone", "inherits", "exact")]
    edges += [("member:A", "member:B", "calls", "exact"), ("member:B", "member:A", "calls", "exact"), ("member:C", "member:C", "calls", "exact"), ("member:C", "member:Gone", "calls", "exact")]
    found = [(1, "CS8602", "warning", "m", "p.csproj", "A.cs", 2, 2, ["compiler", "nullable"]), (2, "CS0168", "warning", "m", "p.csproj", "A.cs", 10, 12, ["compiler"]), (3, "X1", "info", "m", None, None, None, None, None)]
    return empty_facts(
        spark, files=df(files, schemas.FILES), types=df(types, schemas.TYPES), members=df(members, schemas.MEMBERS), namespaces=df(spaces, schemas.NAMESPACES), edges=df(edges, schemas.EDGES),
        diagnostics=df(found, schemas.DIAGNOSTICS), projects=df([("p.csproj", True), ("q.csproj", True), ("r.csproj", False)], schemas.PROJECTS), project_deps=df([("p.csproj", "q.csproj"), ("p.csproj", "r.csproj")], schemas.PROJECT_DEPS),
        memberships=df([(key, f"{x}.cs") for x in names], schemas.MEMBERSHIPS), regions=df([("A.cs", 1, 10, "duplication_block:000001"), ("A.cs", 8, 12, "duplication_block:000002")], schemas.REGIONS), health=df(health, schemas.HEALTH),
    )


@pytest.fixture(scope="module")
def run(spark):
    facts = trusted_facts(spark)
    metrics = all_metrics(facts).cache()
    ranked = hotspots.rank(hotspots.candidates(facts), metrics, facts.health).cache()
    return facts, metrics, ranked


def value(metrics, target, metric, tags=None):
    rows = [r for r in metrics if r.target_id == target and r.metric_id == metric and (r.tags or None) == tags]
    assert len(rows) == 1, (target, metric, rows)
    return rows[0].numeric_value


def test_values(run):
    m = run[1].collect()
    v = lambda t, metric, tags=None: value(m, t, metric, tags)
    assert (v("type:A", "outgoing_type_dependency_count"), v("type:A", "incoming_type_dependency_count")) == (2, 1)
    assert (v("type:A", "transitive_type_dependency_count"), v("type:E", "transitive_type_dependent_count"), v("type:C", "transitive_type_dependent_count")) == (4, 4, 2)
    assert (v("type:A", "dependency_component_size"), v("type:A", "dependency_cycle_membership"), v("type:F", "dependency_component_size")) == (2, 1, 0)
    assert (v("member:A", "recursive_component_size"), v("member:C", "recursive_component_size"), v("member:D", "recursive_component_size")) == (2, 1, 0)
    assert (v("member:C", "distinct_outgoing_callee_count"), v("type:A", "distinct_incoming_caller_count")) == (1, 1)
    assert (v("namespace:k/N:One", "outgoing_namespace_dependency_count"), v("namespace:k/N:Two", "incoming_namespace_dependency_count"), v("namespace:k/N:One", "namespace_dependency_component_size")) == (1, 1, 0)
    assert v("solution:root", "lines_of_code") == 120 and v("solution:root", "token_line_ratio") == pytest.approx(90 / 120)
    assert (v("file:A.cs", "duplicated_block_count"), v("file:A.cs", "duplicated_line_count"), v("solution:root", "duplicated_line_count"), v("file:B.cs", "duplicated_line_count")) == (2, 12, 12, 0)
    assert v("file:A.cs", "duplicated_block_count", ["duplication_block:000002"]) == 1
    assert (v("file:A.cs", "diagnostic_count"), v("member:A", "diagnostic_count"), v("file:B.cs", "diagnostic_count"), v("file:A.cs", "diagnostic_count", ["compiler"]), v("type:A", "diagnostic_count", ["nullable"])) == (2, 1, 0, 2, 1)
    assert (v("solution:root", "max_member_cyclomatic_complexity"), v("solution:root", "p95_member_cyclomatic_complexity"), v("file:C.cs", "type_count"), v("file:C.cs", "member_count")) == (6, 6, 1, 1)
    assert (v("type:B", "public_api_documentation_ratio"), v("member:B", "cfg_cyclomatic_complexity"), v("type:C", "weighted_member_complexity")) == (0.25, 1, 3)
    assert not [r for r in m if r.metric_id == "inheritance_depth" and r.target_id == "type:A"]


def test_row_counts(run):
    facts, metrics, ranked = run
    every = union_all([metrics, hotspots.rank_metrics(ranked)])
    counts = {(r.target_kind, r.target_id): r.n for r in every.groupBy("target_kind", "target_id").agg(F.count("*").alias("n")).collect()}
    assert counts["solution", "solution:root"] == 24
    assert counts["file", "file:B.cs"] == 26 and counts["file", "file:A.cs"] == 26 + 2 + 2
    assert counts["type", "type:A"] == 25 - 4 + 2 and counts["type", "type:B"] == 26
    assert counts["member", "member:A"] == 11 + 2 and counts["member", "member:B"] == 11 + 9
    assert counts["namespace", "namespace:k/N:One"] == 4
    projects = [n for (kind, _), n in counts.items() if kind == "project"]
    assert sorted(projects) == [20, 24, 31]  # not analysed, without files, with a public API
    assert len({r.metric_id for r in every.select("metric_id").distinct().collect()}) == 66
    keys = every.groupBy(RUN, "target_id", "metric_id", F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))).alias("t")).count().where("count > 1")
    assert keys.count() == 0 and validate.metric_violations(every).count() == 0


def test_untrusted_runs_have_no_semantic_metrics(spark):
    facts = trusted_facts(spark, [("degraded", "msbuild", "failed", "not_run", False, False, [])])
    ids = {r.metric_id for r in all_metrics(facts).select("metric_id").distinct().collect()}
    assert len(ids) == 33 and "diagnostic_count" not in ids


def test_ranking(run):
    _, metrics, ranked = run
    out = ranked.sort("rank_no").collect()
    assert [r.rank_no for r in out] == list(range(1, 19))
    best = {r.target_id: r for r in out}
    f = best["member:F"]
    assert f.rank_score == pytest.approx(0.75) and "cyclomatic_complexity=6 p1 w0.25" in f.reasons and sum(c.weight for c in f.components) == pytest.approx(1)
    assert [r.target_id for r in hotspots.top_hotspots(ranked, 3).sort("rank_no").collect()] == [r.target_id for r in out[:3]]
    assert hotspots.top_hotspots(ranked, 0).count() == 0


def test_missing_components_and_ties(spark):
    targets = spark.createDataFrame([("run", "member", n, n, "semantic", "f", 1, 1) for n in ("member:b", "member:a", "member:none")], f"{RUN} string, target_kind string, target_id string, target_name string, target_id_stability string, file_path string, start_line int, end_line int")
    rows = [("run", "member", t, m, v, None) for t in ("member:a", "member:b") for m, v in (("cognitive_complexity", 0.0), ("member_length", 2.0))]
    metrics = spark.createDataFrame(rows, f"{RUN} string, target_kind string, target_id string, metric_id string, numeric_value double, tags array<string>")
    health = spark.createDataFrame([("run", True)], f"{RUN} string, diagnostics_included_in_hotspot_rank boolean")
    out = hotspots.rank(targets, metrics, health).sort("rank_no").collect()
    assert [(r.target_id, r.rank_score) for r in out] == [("member:a", 0.333333), ("member:b", 0.333333), ("member:none", 0.0)]
    assert out[0].components[0].weight == pytest.approx(2 / 3) and out[0].reasons == ["member_length=2 p1 w0.33"]


SOURCE = """namespace Shop;

/// <summary>Adds.</summary>
public class Adder
{
    public int Add(int a, int b)
    {
        return a > 0 && b > 0 ? a + b : 0;
    }
}
"""


def test_engine_end_to_end(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "obj").mkdir()
    (root / "src/Adder.cs").write_text(SOURCE, encoding="utf-8-sig")
    (root / "src/With space+é.cs").write_text("class Two { int P => 1; }\n")
    (root / "src/A.g.cs").write_text("class Generated { }")
    (root / "obj/B.cs").write_text("class Hidden { }")
    (root / "src/Shop.csproj").write_text('<Project><ItemGroup><ProjectReference Include="..\\Other\\Other.csproj" /></ItemGroup></Project>')
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere/Far.cs").write_text("class Far { }")
    (root / "link").symlink_to(tmp_path / "elsewhere")
    (root / "Link.cs").symlink_to(tmp_path / "elsewhere/Far.cs")
    (root / "Other").mkdir()
    (root / "Other/Other.csproj").write_text("<Project />")
    engine = Engine(spark)
    out = str(tmp_path / "out")
    summary = engine.run(str(root), out, include_text=True)
    assert (summary["fileCount"], summary["typeCount"], summary["memberCount"], summary["projectCount"]) == (2, 2, 2, 1) and engine.accepted(summary)
    lines = [json.loads(x) for x in open(f"{out}/metrics.ndjson")]
    assert {x["filePath"] for x in lines if x["targetKind"] == "file"} == {"src/Adder.cs", "src/With space+é.cs"}
    assert next(x for x in lines if x["metricId"] == "cyclomatic_complexity" and "Add#" in x["targetId"])["numericValue"] == 3
    chunk = next(json.loads(x) for x in open(f"{out}/chunks.ndjson") if '"file_header"' in x and "Adder" in x)
    assert chunk["text"] == "namespace Shop;\n\n/// <summary>Adds.</summary>"
    assert engine.validate(out).count() == 0
    manifest = json.loads(open(f"{out}/manifest.json").read())
    assert manifest["input"]["kind"] == "directory" and manifest["input"]["options"]["includeChunkText"] is True
    kept = str(tmp_path / "kept")
    shutil.copytree(out, kept)
    second = engine.run(str(root / "src/Shop.csproj"), out)  # replaces its own output
    assert second["fileCount"] == 2
    broken = [json.loads(x) for x in open(f"{out}/metrics.ndjson")]
    broken[0]["targetId"] = "file:gone"
    with open(f"{out}/metrics.ndjson", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in [*broken, broken[1]])
    assert {r.rule for r in engine.validate(out).collect()} >= {"missing node", "count", "duplicate observation"}
    profile = {
        "schemaVersion": "1.0.0", "id": "p", "version": "1.0.0", "artifactContractVersion": "0.2.0", "allowedAnalysisModes": ["syntax"], "allowedTargetIdStabilities": ["line_fallback"],
        "selectors": {"includeFilePaths": ["src/*.cs"], "excludeFilePaths": ["**/With*"], "requireTrusted": False}, "primary": {"key": "score", "direction": "minimize"},
        "operations": [
            {"operation": "thresholdDebt", "targetKind": "member", "thresholds": [{"metricId": "cyclomatic_complexity", "metricVersion": "1.0.0", "maximum": 1, "weight": 2}], "outputs": {"gapSum": "debt", "squaredGapSum": "sq", "violatingTargetCount": "bad", "maxTargetGap": "max"}},
            {"operation": "weightedSum", "terms": [{"key": "debt", "weight": 1}, {"key": "sq", "weight": 0.5}], "output": "score"},
        ],
    }
    result = engine.score(kept, json.dumps(profile))
    assert result["values"] == {"bad": 1, "debt": 4, "max": 4, "score": 12, "sq": 16} and result["primary"]["value"] == 12
    for change, error in [({"allowedAnalysisModes": ["semantic"]}, scoring.PreconditionsNotMet), ({"selectors": {}}, scoring.PreconditionsNotMet), ({"allowedTargetIdStabilities": ["semantic"]}, scoring.PreconditionsNotMet), ({"x": 1}, scoring.InvalidProfile)]:
        with pytest.raises(error):
            engine.score(kept, json.dumps(profile | change))
    with pytest.raises(ValueError, match="overwrite"):
        engine.run(str(root), str(tmp_path))
    (tmp_path / "other").mkdir()
    (tmp_path / "other/file").write_text("mine")
    with pytest.raises(ValueError, match="something else"):
        reporting.publish(out, str(tmp_path / "other"))


@pytest.mark.parametrize(
    "edit",
    [
        lambda p: p.update(schemaVersion="2.0.0"), lambda p: p.update(version="1.0"), lambda p: p["operations"].clear(), lambda p: p["primary"].update(key="nothing"), lambda p: p["operations"][1]["terms"][0].update(key="later"),
        lambda p: p["operations"][0]["thresholds"][0].update(weight=0), lambda p: p["operations"][0].update(targetKind="solution"), lambda p: p["operations"].append(dict(p["operations"][0])), lambda p: p["selectors"].update(minTargetCount=0),
    ],
)
def test_profiles_are_checked(edit):
    good = {
        "schemaVersion": "1.0.0", "id": "p", "version": "1.0.0", "artifactContractVersion": "0.2.0", "allowedAnalysisModes": ["syntax"], "allowedTargetIdStabilities": ["semantic"], "selectors": {}, "primary": {"key": "s", "direction": "minimize"},
        "operations": [
            {"operation": "thresholdDebt", "targetKind": "type", "thresholds": [{"metricId": "m", "metricVersion": "1.0.0", "maximum": 1}], "outputs": {"gapSum": "a", "squaredGapSum": "b", "violatingTargetCount": "c", "maxTargetGap": "d"}},
            {"operation": "weightedSum", "terms": [{"key": "a", "weight": 1}], "output": "s"},
        ],
    }
    assert scoring.parse_profile(json.dumps(good)).primary == ("s", "minimize")
    edit(good)
    with pytest.raises(scoring.InvalidProfile):
        scoring.parse_profile(json.dumps(good))


def test_profile_with_a_repeated_property():
    with pytest.raises(scoring.InvalidProfile, match="twice"):
        scoring.parse_profile('{"id": 1, "id": 2}')


def test_shared_files_and_nearest_projects(spark):
    sources = spark.createDataFrame([("a/x.cs", "class A { }"), ("a/b/y.cs", "class B { void M() { } }"), ("z.cs", None)], "file_path string, text string")
    facts = collect_facts(spark, sources, spark.createDataFrame([("a/p.csproj",), ("a/b/q.csproj",)], "project_path string"), root_path="/root")
    assert sorted((r.project_path) for r in facts.projects.collect()) == ["/root", "a/b/q.csproj", "a/p.csproj"]
    nodes, edges = reporting.graph_nodes(facts), reporting.graph_edges(facts)
    assert validate.node_violations(nodes).count() == 0 and validate.edge_violations(edges, nodes).count() == 0
    assert sorted(r.kind for r in nodes.collect()) == sorted(["solution"] + ["project"] * 3 + ["namespace"] * 2 + ["file"] * 3 + ["type"] * 2 + ["member"])


def test_cli(capsys):
    assert cli.main(["list-metrics"]) == 0 and len(capsys.readouterr().out.splitlines()) == 66
    assert cli.main(["explain", "hotspot_rank@2.0.0"]) == 0 and cli.main(["explain", "nope"]) == 1


def test_diagnostics_and_health(spark, rows):
    ddl = f"{RUN} string, id string, severity string, message string, project_path string, file_path string, start_line int, end_line int, tags array<string>"
    data = [
        ("r", "CS8602", "Warning", "m", "p", "A.cs", 1, 1, None), ("r", "CS8602", "Warning", "m", "p", "A.cs", 1, 1, ["x"]), ("r", "CS0001", "Error", "m", "p", "A.ImplicitUsings.g.cs", 1, 1, None),
        ("r", "CS0001", "Hidden", "m", "p", "Gone.cs", 1, 1, None), ("r", "IDE1", "Hidden", "m", None, None, None, None, None),
    ]
    out = diagnostics.normalise(spark.createDataFrame(data, ddl), spark.createDataFrame([("r", "A.cs"), ("r", "A.ImplicitUsings.g.cs")], f"{RUN} string, file_path string"))
    assert sorted((r.id, r.severity, tuple(r.tags)) for r in out.collect()) == [("CS8602", "warning", ("compiler", "nullable", "x")), ("IDE1", "info", ("analyzer",))]
    failures = spark.createDataFrame([("r", "failure", "P.csproj: build: text"), ("r", "failure", "P.csproj: bad"), ("r", "warning", "other")], f"{RUN} string, kind string, message string")
    log = spark.createDataFrame([("r", "warning", "P.csproj", "text"), ("r", "warning", "P.csproj", "bad"), ("r", "error", "P.csproj", "bad")], f"{RUN} string, level string, project string, text string")
    assert sorted((r.message, r.kind) for r in diagnostics.reclassify(failures, log).collect()) == [("P.csproj: bad", "failure"), ("P.csproj: build: text", "warning"), ("other", "warning")]
    loads = spark.createDataFrame([("a", True, True, None, "msbuild", "success", []), ("b", True, False, None, "msbuild", "failed", []), ("c", False, False, "boom", "x", "x", []), ("d", False, False, None, "x", "x", [])], f"{RUN} string, used_semantic boolean, trust_diagnostics boolean, initialization_failure string, semantic_model string, restore_status string, messages array<string>")
    assert [(r.analysis_quality, r.semantic_model, r.restore_status, r.trusted_diagnostics) for r in diagnostics.health(loads).sort(RUN).collect()] == [("trusted", "msbuild", "success", True), ("degraded", "msbuild", "failed", False), ("degraded", "not_available", "not_run", False), ("syntax_only", "none", "not_run", False)]


def test_documents_are_checked_against_their_shapes():
    stamp, counts = "2031-01-01T00:00:00Z", {c: 0 for c in ("projectCount", "fileCount", "typeCount", "memberCount", "metricResultCount", "diagnosticCount")}
    health = {"analysisQuality": "trusted", "semanticModel": "msbuild", "restoreStatus": "success", "buildStatus": "not_run", "trustedDiagnostics": True, "diagnosticsIncludedInHotspotRank": True, "messages": []}
    summary = {"schemaVersion": "0.2.0", "rootPath": "/r", **counts, "analysisHealth": health, "hotspots": []}
    assert list(contracts.problems(summary, contracts.SUMMARY, "summary")) == []
    wrong = summary | {"fileCount": -1, "extra": 1, "analysisHealth": health | {"analysisQuality": "fine"}, "hotspots": [{"rankScore": 2}]}
    found = list(contracts.problems(wrong, contracts.SUMMARY, "summary"))
    assert {"summary.extra is unknown", "summary.fileCount isn't as it must be: -1", "summary.analysisHealth.analysisQuality isn't as it must be: 'fine'", "summary.hotspots[0] lacks targetId", "summary.hotspots[0].rankScore isn't as it must be: 2"} <= set(found)
    assert "manifest lacks tool" in set(contracts.manifest_problems({"startedAt": stamp})) and "manifest.input lacks selectedPath" in set(contracts.manifest_problems({"input": {"kind": "project"}}))
    assert contracts.depth([[{"a": [1]}]]) == 4 and contracts.depth(3) == 0


def test_command_line(capsys):
    for wrong in (["analyze", "."], ["analyze", ".", "-o", "x", "--top", "-1"], ["analyze", ".", "-o", "x", "--include", " "], ["nothing"]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong)
        assert e.value.code == cli.INPUT_ERROR
    assert cli.main(["analyze", ".", "-o", "x", "--semantic"]) == cli.INPUT_ERROR and cli.main(["help"]) == cli.OK
    assert cli.main(["explain", "nothing"]) == cli.INPUT_ERROR and cli.main(["explain", "lines_of_code@1.0.0"]) == cli.OK
