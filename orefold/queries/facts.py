"""Queries that run the shipped plans over fact tables made of the delivered graph, metrics and chunks, and their SQL.

A run's facts are its nodes (files, types, members and projects), its edges, its values as control flow, and its chunks in place of diagnostics. What the tables don't hold,
such as the text of a file or its comment lines, is made by a rule that both sides follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import scalar as fn
from orefold.plans import facts as fx
from orefold.plans import hotspots, metrics, reporting
from orefold.plans.facts import RUN, Facts, empty_facts
from orefold.runtime import materialize
from orefold.schemas import MEMBERS, TYPES

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Rules for line counters that the tables don't hold, in terms of the lines of code.
COUNTERS = {
    "token_line_count": "loc div 2", "blank_line_count": "loc div 3", "comment_only_line_count": "loc % 7", "commented_line_count": "loc % 11", "mixed_code_comment_line_count": "loc % 2", "documentation_comment_line_count": "loc % 5",
}
FLOW = ("cyclomatic_complexity", "decision_point_count", "cognitive_complexity", "nesting_depth")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nodes, edges and values, one row each per run, written once."""
    nodes = _t(spark, d, "graph_nodes").where("id IS NOT NULL").groupBy(RUN, "id").agg(
        *[F.min(c).alias(c) for c in ("kind", "name", "target_id_stability", "file_path", "project_key", "start_line")], F.max("end_line").alias("end_line"))
    edges = _t(spark, d, "graph_edges").where("from_id IS NOT NULL AND to_id IS NOT NULL").select(RUN, "from_id", "to_id", "kind", "confidence").distinct()
    v = F.col("numeric_value")
    values = _t(spark, d, "metrics").where((F.coalesce(F.size("tags"), F.lit(0)) <= 0) & fn.is_finite(v) & ~F.isnan(v)).groupBy(RUN, "target_id", "metric_id").agg(F.max(v).alias("numeric_value"))
    return {"nodes": materialize(nodes, "nodes"), "edges": materialize(edges, "edges"), "values": materialize(values, "values")}


def _facts(spark: SparkSession, d: str, parts: dict[str, DataFrame]) -> Facts:
    nodes, edges = parts["nodes"], parts["edges"]
    ok = "file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL AND start_line <= end_line"
    placed = nodes.where(ok).withColumn("loc", F.expr("end_line - start_line + 1"))
    of = lambda kind: placed.where(F.col("kind") == kind).withColumnRenamed("id", "target_id")
    first = of("file").groupBy(RUN, "file_path").agg(F.min("target_id").alias("target_id"))
    files = of("file").join(first, [RUN, "file_path", "target_id"], "left_semi").withColumns({"seq": F.lit(0).cast("bigint"), "lines_of_code": F.col("loc"), **{c: F.expr(e).cast("int") for c, e in COUNTERS.items()}})
    types = of("type")
    ids = types.select(RUN, F.col("target_id").alias("parent_type_target_id"))
    parents = edges.where("kind = 'declares'").select(RUN, F.col("from_id").alias("parent_type_target_id"), F.col("to_id").alias("target_id")).join(ids, [RUN, "parent_type_target_id"], "left_semi")
    parents = parents.groupBy(RUN, "target_id").agg(F.min("parent_type_target_id").alias("parent_type_target_id"))
    wide = parts["values"].groupBy(RUN, "target_id").pivot("metric_id", [*FLOW, "parameter_count"]).agg(F.max("numeric_value"))
    span = F.array(F.struct("file_path", "start_line", F.lit(1).alias("start_column"), "end_line")).alias("declarations")
    kinds = dict(x.strip().split(" ", 1) for x in MEMBERS.split(", ") if " " in x)
    members = of("member").join(parents, [RUN, "target_id"]).join(wide, [RUN, "target_id"], "left").select(
        RUN, "target_id", "target_id_stability", "parent_type_target_id", "project_key", "name", F.lit("member_body").alias("chunk_kind"), "file_path", "start_line", "end_line", span,
        F.struct(*[F.col(c).cast("int").alias(c) for c in FLOW]).alias("control_flow"), F.col("loc").alias("member_length"), F.col("parameter_count").cast("int").alias("parameter_count"), F.lit(None).cast(kinds["operations"]).alias("operations"))
    count = members.groupBy(RUN, F.col("parent_type_target_id").alias("target_id")).agg(F.count("*").cast("int").alias("member_count"))
    semantic = dict(x.strip().split(" ", 1) for x in TYPES.split(", ") if " " in x)["semantic"]
    types = types.join(count, [RUN, "target_id"], "left").select(
        RUN, "target_id", "target_id_stability", fn.file_id(F.col("file_path")).alias("parent_file_target_id"), "project_key", "name", "file_path", "start_line", "end_line", span, F.col("loc").alias("lines_of_code"),
        (F.col("loc") - 1).alias("token_line_count"), F.coalesce("member_count", F.lit(0)).alias("member_count"), F.lit(None).cast(semantic).alias("semantic"))
    projects = nodes.where("kind = 'project' AND file_path IS NOT NULL").select(RUN, F.col("file_path").alias("project_path"), F.lit(True).alias("analyzed")).distinct()
    inside = edges.where("kind = 'contains' AND from_id LIKE 'project:%'").select(RUN, F.expr("substring(from_id, 9)").alias("project_key"), F.col("to_id").alias("target_id"))
    memberships = inside.join(files.select(RUN, "target_id", "file_path"), [RUN, "target_id"]).select(RUN, "project_key", "file_path").distinct()
    marks = _t(spark, d, "chunks").where("chunk_id IS NOT NULL").groupBy(RUN, "chunk_id").agg(*[F.min(c).alias(c) for c in ("file_path", "start_line", "end_line", "chunk_kind")])
    diagnostics = marks.select(RUN, F.xxhash64("chunk_id").alias("diag_id"), F.lit("CS0001").alias("id"), F.lit("warning").alias("severity"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("project_path"), "file_path", "start_line", "end_line", F.array("chunk_kind").alias("tags"))
    sources = files.select(RUN, "file_path", F.array_join(F.transform(F.sequence(F.lit(1), "end_line"), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("text"))
    runs = nodes.select(RUN).distinct()
    health = runs.select(RUN, F.lit("trusted").alias("analysis_quality"), F.lit("full").alias("semantic_model"), F.lit("ok").alias("restore_status"), F.lit("not_run").alias("build_status"), F.lit(True).alias("trusted_diagnostics"), F.lit(True).alias("diagnostics_included_in_hotspot_rank"), F.array().cast("array<string>").alias("messages"))
    return empty_facts(spark, files=files.drop("kind", "name", "loc"), types=types, members=members, edges=edges, projects=projects, memberships=memberships, diagnostics=diagnostics, sources=sources, health=health)


def table_facts(spark: SparkSession, d: str) -> Facts:
    return _facts(spark, d, _parts(spark, d))


_FACTS = """WITH RECURSIVE node AS (SELECT run_id, id, min(kind) AS kind, min(name) AS name, min(target_id_stability) AS stab, min(file_path) AS path, min(project_key) AS pk, min(start_line) AS a, max(end_line) AS b FROM graph_nodes WHERE id IS NOT NULL GROUP BY 1, 2),
ed AS (SELECT DISTINCT run_id, from_id, to_id, kind, confidence FROM graph_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
val AS (SELECT run_id, target_id, metric_id, max(numeric_value) AS v FROM metrics WHERE coalesce(len(tags), 0) = 0 AND isfinite(numeric_value) GROUP BY 1, 2, 3),
ok AS (SELECT *, b - a + 1 AS loc FROM node WHERE path IS NOT NULL AND a <= b),
fil AS (SELECT * FROM ok WHERE kind = 'file' QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY id) = 1),
typ AS (SELECT * FROM ok WHERE kind = 'type'),
par AS (SELECT e.run_id, to_id AS id, min(from_id) AS parent FROM ed e JOIN typ t ON t.run_id = e.run_id AND t.id = e.from_id WHERE e.kind = 'declares' GROUP BY 1, 2),
mem AS (SELECT m.*, p.parent, {flow} FROM ok m JOIN par p ON p.run_id = m.run_id AND p.id = m.id {joins} WHERE m.kind = 'member'),
prj AS (SELECT DISTINCT run_id, path, left(sha256(path), 16) AS key, 'project:' || left(sha256(path), 16) AS id FROM node WHERE kind = 'project' AND path IS NOT NULL),
given AS (SELECT DISTINCT e.run_id, substr(from_id, 9) AS key, f.path FROM ed e JOIN fil f ON f.run_id = e.run_id AND f.id = e.to_id WHERE e.kind = 'contains' AND from_id LIKE 'project:%'),
ship AS (SELECT * FROM given UNION SELECT run_id, pk, path FROM fil WHERE run_id NOT IN (SELECT run_id FROM given)),
runs AS (SELECT DISTINCT run_id FROM node)
""".replace("{flow}", ", ".join(f"v{i}.v::INT AS {c}" for i, c in enumerate((*FLOW, "parameter_count")))).replace(
    "{joins}", " ".join(f"LEFT JOIN val v{i} ON v{i}.run_id = m.run_id AND v{i}.target_id = m.id AND v{i}.metric_id = '{c}'" for i, c in enumerate((*FLOW, "parameter_count"))))


def _lines_sql() -> str:
    """Line counters and ratios of files, projects and the solution."""
    duck = {c: e.replace("div", "//") for c, e in COUNTERS.items()}
    counters = ["lines_of_code", *metrics.LINE_COUNTERS[1:]]
    sums = "SELECT run_id, 'file' AS kind, id, loc AS lines_of_code, " + ", ".join(f"({duck[c]}) AS {c}" for c in counters[1:]) + " FROM fil"
    total = lambda kind, who, rows: f"SELECT x.run_id, '{kind}', {who}, " + ", ".join(f"coalesce(sum({'f.loc' if c == 'lines_of_code' else duck[c].replace('loc', 'f.loc')}), 0)" for c in counters) + f" FROM {rows} GROUP BY 1, 3"
    project = total("project", "x.id", "prj x LEFT JOIN ship s ON s.run_id = x.run_id AND s.key = x.key LEFT JOIN fil f ON f.run_id = s.run_id AND f.path = s.path")
    solution = total("solution", "'solution:root'", "runs x LEFT JOIN fil f ON f.run_id = x.run_id")
    each = [f"SELECT run_id, '{c}' AS metric_id, kind AS target_kind, id AS target_id, {c}::DOUBLE AS value FROM lin" for c in counters]
    each += [f"SELECT run_id, '{r}', kind, id, {c}::DOUBLE / lines_of_code FROM lin WHERE lines_of_code <> 0" for r, c in metrics.LINE_RATIOS.items()]
    return f", lin AS ({sums} UNION ALL {project} UNION ALL {solution}) " + " UNION ALL ".join(each)


def _population_sql() -> str:
    """Maxima, percentiles and counts of members and types by file, type, project and solution."""
    measured = {"member_length": "m.loc", "member_cyclomatic_complexity": "m.cyclomatic_complexity", "member_cognitive_complexity": "m.cognitive_complexity", "member_nesting_depth": "m.nesting_depth"}
    scopes = {
        "file": ("fil x", "x.id", "m.path = x.path"), "type": ("typ x", "x.id", "m.parent = x.id"), "project": ("prj x", "x.id", "m.pk = x.key"), "solution": ("runs x", "'solution:root'", "true"),
    }
    out = []
    for kind, (rows, who, on) in scopes.items():
        over = f"FROM {rows} LEFT JOIN mem m ON m.run_id = x.run_id AND {on} GROUP BY x.run_id, {who}"
        for name, column in measured.items():
            out.append(f"SELECT x.run_id, 'max_{name}' AS metric_id, '{kind}' AS target_kind, {who} AS target_id, coalesce(max({column}), 0)::DOUBLE AS value {over}")
            if name != "member_nesting_depth":
                out.append(f"SELECT x.run_id, 'p95_{name}', '{kind}', {who}, coalesce(quantile_disc({column}, 0.95), 0)::DOUBLE {over}")
        if kind in ("file", "type"):
            out.append(f"SELECT x.run_id, 'member_count', '{kind}', {who}, count(m.id)::DOUBLE {over}")
        if kind == "type":
            out.append(f"SELECT x.run_id, 'weighted_member_complexity', 'type', {who}, coalesce(sum(m.cyclomatic_complexity), 0)::DOUBLE {over}")
        if kind in ("project", "solution"):
            types = over.replace("mem m", "typ m")
            out += [f"SELECT x.run_id, 'max_type_lines_of_code', '{kind}', {who}, coalesce(max(m.loc), 0)::DOUBLE {types}", f"SELECT x.run_id, 'p95_type_lines_of_code', '{kind}', {who}, coalesce(quantile_disc(m.loc, 0.95), 0)::DOUBLE {types}"]
    out.append("SELECT x.run_id, 'type_count', 'file', x.id, count(DISTINCT t.a)::DOUBLE FROM fil x LEFT JOIN typ t ON t.run_id = x.run_id AND t.path = x.path GROUP BY x.run_id, x.id")
    out += ["SELECT run_id, 'lines_of_code', 'type', id, loc::DOUBLE FROM typ", "SELECT run_id, 'token_line_count', 'type', id, (loc - 1)::DOUBLE FROM typ", "SELECT run_id, 'member_length', 'member', id, loc::DOUBLE FROM mem"]
    out += [f"SELECT run_id, '{c}', 'member', id, {c}::DOUBLE FROM mem WHERE {c} IS NOT NULL" for c in (*FLOW, "parameter_count")]
    return " UNION ALL ".join(out)


def _plain(long: DataFrame) -> DataFrame:
    return long.select(RUN, "metric_id", "target_kind", "target_id", "value")


@query(_FACTS + _lines_sql() + " UNION ALL " + _population_sql())
def fact_syntax_metrics(spark, d):
    """metrics.syntax_metrics: lines, counts, complexities and their aggregates."""
    return _plain(metrics.syntax_metrics(table_facts(spark, d)))


_CLOSED = """, own AS (SELECT run_id, id, parent AS owner FROM mem UNION SELECT run_id, id, id FROM typ),
dep AS (SELECT DISTINCT e.run_id, o.owner AS a, e.to_id AS b FROM ed e JOIN own o ON o.run_id = e.run_id AND o.id = e.from_id JOIN typ t ON t.run_id = e.run_id AND t.id = e.to_id WHERE e.kind IN ('inherits', 'implements', 'uses_type') AND o.owner <> e.to_id),
cal AS (SELECT DISTINCT e.run_id, e.from_id AS a, e.to_id AS b FROM ed e JOIN mem f ON f.run_id = e.run_id AND f.id = e.from_id JOIN mem t ON t.run_id = e.run_id AND t.id = e.to_id WHERE e.kind = 'calls'),
dc AS (SELECT run_id, a, b FROM dep UNION SELECT c.run_id, c.a, e.b FROM dc c JOIN dep e ON e.run_id = c.run_id AND e.a = c.b),
cc AS (SELECT run_id, a, b FROM cal UNION SELECT c.run_id, c.a, e.b FROM cc c JOIN cal e ON e.run_id = c.run_id AND e.a = c.b),
dl AS (SELECT x.run_id, x.a AS id, count(*) AS n FROM dc x JOIN dc y ON y.run_id = x.run_id AND y.a = x.b AND y.b = x.a GROUP BY 1, 2),
cl AS (SELECT x.run_id, x.a AS id, count(*) AS n FROM cc x JOIN cc y ON y.run_id = x.run_id AND y.a = x.b AND y.b = x.a GROUP BY 1, 2)
"""


def _graph_sql() -> str:
    count = lambda metric, kind, rows, edges, end, where="": f"SELECT x.run_id, '{metric}' AS metric_id, '{kind}' AS target_kind, x.id AS target_id, count(e.a)::DOUBLE AS value FROM {rows} x LEFT JOIN {edges} e ON e.run_id = x.run_id AND e.{end} = x.id {where} GROUP BY 1, 4"
    size = lambda metric, kind, rows, loops, flag=False: f"SELECT x.run_id, '{metric}', '{kind}', x.id, {'(l.n IS NOT NULL)::INT' if flag else 'coalesce(l.n, 0)'}::DOUBLE FROM {rows} x LEFT JOIN {loops} l ON l.run_id = x.run_id AND l.id = x.id"
    side = lambda metric, end, other: f"SELECT x.run_id, '{metric}', 'type', x.id, count(DISTINCT e.{other})::DOUBLE FROM typ x LEFT JOIN mem m ON m.run_id = x.run_id AND m.parent = x.id LEFT JOIN cal e ON e.run_id = m.run_id AND e.{end} = m.id GROUP BY 1, 4"
    parts = [
        count("outgoing_type_dependency_count", "type", "typ", "dep", "a"), count("incoming_type_dependency_count", "type", "typ", "dep", "b"), size("dependency_cycle_membership", "type", "typ", "dl", True), size("dependency_component_size", "type", "typ", "dl"),
        count("transitive_type_dependency_count", "type", "typ", "dc", "a", "AND e.a <> e.b"), count("transitive_type_dependent_count", "type", "typ", "dc", "b", "AND e.a <> e.b"),
        count("distinct_outgoing_callee_count", "member", "mem", "cal", "a"), count("distinct_incoming_caller_count", "member", "mem", "cal", "b"), size("recursive_component_size", "member", "mem", "cl"),
        side("distinct_outgoing_callee_count", "a", "b"), side("distinct_incoming_caller_count", "b", "a"),
    ]
    parts += [f"SELECT run_id, '{m}', 'project', id, 0.0::DOUBLE FROM prj" for m in ("outgoing_project_dependency_count", "incoming_project_dependency_count", "project_dependency_cycle_membership", "project_dependency_component_size")]
    return " UNION ALL ".join(parts)


@query(_FACTS + _CLOSED + _graph_sql())
def fact_graph_metrics(spark, d):
    """metrics.graph_metrics: lifted dependencies, callers, cycles and reachability of every run."""
    return _plain(metrics.graph_metrics(table_facts(spark, d)))


_MARKS = """, mark AS (SELECT run_id, chunk_id, min(file_path) AS path, min(start_line) AS a, min(end_line) AS b, min(chunk_kind) AS tag FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1, 2),
tgt AS (SELECT run_id, 'file' AS kind, id, path, a, b FROM fil UNION ALL SELECT run_id, 'type', id, path, a, b FROM typ UNION ALL SELECT run_id, 'member', id, path, a, b FROM mem),
hit AS (SELECT t.run_id, t.kind, t.id, m.chunk_id, m.tag FROM tgt t LEFT JOIN mark m ON m.run_id = t.run_id AND m.path = t.path AND m.a <= m.b AND m.a <= t.b AND m.b >= t.a)
SELECT run_id, kind AS target_kind, id AS target_id, '' AS tag, count(DISTINCT chunk_id)::DOUBLE AS value FROM hit GROUP BY 1, 2, 3
UNION ALL SELECT run_id, kind, id, tag, count(DISTINCT chunk_id)::DOUBLE FROM hit WHERE tag IS NOT NULL GROUP BY 1, 2, 3, 4"""


@query(_FACTS + _MARKS)
def fact_diagnostic_metrics(spark, d):
    """metrics.diagnostic_metrics, with chunks in place of diagnostics and their kinds as tags."""
    rows = metrics.diagnostic_metrics(table_facts(spark, d))
    return rows.select(RUN, "target_kind", "target_id", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tag"), "value")


_WEIGHTS_SQL = ", ".join(f"('{kind}', '{m}', {w}::DOUBLE, {n})" for kind, parts in hotspots.WEIGHTS.items() for n, (m, w) in enumerate(parts))
# rounded by the decimal text of a double, half away from zero; sums go in the order of the components, since the sixth digit may hang on it
_SIX = "round(({})::VARCHAR::DECIMAL(38, 18), 6)::DOUBLE"
_SUM = "list_reduce(list({} ORDER BY place), lambda a, b: a + b)"
_RANKED = f""", w(kind, metric_id, weight, place) AS (VALUES {_WEIGHTS_SQL}),
tgt AS (SELECT run_id, 'file' AS kind, id, 3 AS k FROM fil UNION ALL SELECT run_id, 'type', id, 2 FROM typ UNION ALL SELECT run_id, 'member', id, 1 FROM mem),
raw AS (SELECT t.run_id, t.kind, t.id, weight, place, CASE WHEN v <= 0 THEN 0.0::DOUBLE ELSE cume_dist() OVER (PARTITION BY t.run_id, t.kind, w.metric_id ORDER BY v) END AS p FROM tgt t JOIN val ON val.run_id = t.run_id AND val.target_id = t.id JOIN w ON w.kind = t.kind AND w.metric_id = val.metric_id),
tot AS (SELECT run_id, kind, id, {_SUM.format("weight")} AS total FROM raw GROUP BY 1, 2, 3),
pct AS (SELECT raw.run_id, raw.kind, raw.id, place, weight / total AS weight, {_SIX.format("p")} AS p FROM raw JOIN tot ON tot.run_id = raw.run_id AND tot.kind = raw.kind AND tot.id = raw.id),
agg AS (SELECT run_id, kind, id, {_SUM.format("p * weight")} / {_SUM.format("weight")} AS score, count(*) AS parts FROM pct GROUP BY 1, 2, 3),
sco AS (SELECT t.run_id, t.kind, t.id, t.k, coalesce({_SIX.format("score")}, 0) AS score, coalesce(parts, 0) AS parts FROM tgt t LEFT JOIN agg ON agg.run_id = t.run_id AND agg.kind = t.kind AND agg.id = t.id),
ran AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, k, id) AS rank_no FROM sco)
"""


def _ranked(spark, d) -> DataFrame:
    parts = _parts(spark, d)
    facts = _facts(spark, d, parts)
    kinds = parts["nodes"].select(RUN, F.col("id").alias("target_id"), F.col("kind").alias("target_kind"))
    rows = parts["values"].join(kinds, [RUN, "target_id"]).withColumn("tags", F.lit(None).cast("array<string>"))
    return hotspots.rank(hotspots.candidates(facts), rows, facts.health)


@query(_FACTS + _RANKED + "SELECT run_id, kind AS target_kind, id AS target_id, score AS rank_score, parts, rank_no FROM ran")
def fact_hotspots(spark, d):
    """hotspots.rank over every run's delivered values."""
    return _ranked(spark, d).select(RUN, "target_kind", "target_id", "rank_score", F.size("components").cast("bigint").alias("parts"), F.col("rank_no").cast("bigint").alias("rank_no"))


@query(_FACTS + _RANKED + "SELECT run_id, kind AS target_kind, id AS target_id, score AS rank_score, rank_no FROM ran WHERE score > 0 AND rank_no <= 20")
def fact_hotspots_top(spark, d):
    """hotspots.top_hotspots of every run."""
    return hotspots.top_hotspots(_ranked(spark, d)).select(RUN, "target_kind", "target_id", "rank_score", F.col("rank_no").cast("bigint").alias("rank_no"))


_CHUNKS = """, src AS (SELECT run_id, path, list_transform(generate_series(1, b), lambda i: 'line ' || i) AS l FROM fil),
raw AS (
 SELECT f.run_id, f.id, 'file_header' AS kind, f.path, f.a, least(f.b, greatest(f.a, coalesce(min(t.a), f.b + 1) - 1)) AS b, coalesce(list_sort(list(DISTINCT t.id) FILTER (t.id IS NOT NULL)), []) AS rel FROM fil f LEFT JOIN typ t ON t.run_id = f.run_id AND t.path = f.path GROUP BY f.run_id, f.id, f.path, f.a, f.b
 UNION ALL SELECT t.run_id, t.id, 'type_declaration', t.path, t.a, t.b, list_sort(list_distinct(list_append(coalesce(list(m.id) FILTER (m.id IS NOT NULL), []), 'file:' || t.path))) FROM typ t LEFT JOIN mem m ON m.run_id = t.run_id AND m.parent = t.id GROUP BY t.run_id, t.id, t.path, t.a, t.b
 UNION ALL SELECT m.run_id, m.id, 'member_body', m.path, m.a, m.b, list_sort(list_distinct(list_append(coalesce(list(e.to_id) FILTER (e.to_id IS NOT NULL), []), m.parent))) FROM mem m LEFT JOIN ed e ON e.run_id = m.run_id AND e.from_id = m.id GROUP BY m.run_id, m.id, m.path, m.a, m.b, m.parent),
cut AS (SELECT raw.*, coalesce(array_to_string(l[greatest(1, least(a, len(l))):greatest(greatest(1, least(a, len(l))), least(b, len(l)))], chr(10)), '') AS text FROM raw LEFT JOIN src ON src.run_id = raw.run_id AND src.path = raw.path)
SELECT run_id, 'chunk:' || id || '#' || kind || '@' || path || ':' || a || ':1' AS chunk_id, b AS end_line, ceil(length(text) / 4.0::DOUBLE)::INT AS token_estimate, 'sha256:' || sha256(text) AS text_hash, array_to_string(rel, ',') AS related FROM cut"""


@query(_FACTS + _CHUNKS)
def fact_chunks(spark, d):
    """reporting.chunks: headers, declarations and bodies with their identities, hashes and related targets."""
    rows = reporting.chunks(table_facts(spark, d))
    return rows.select(RUN, "chunk_id", "end_line", "token_estimate", "text_hash", F.array_join("related_target_ids", ",").alias("related"))


@query(_FACTS + """SELECT run_id, 'solution:root' AS from_id, id AS to_id, 'contains' AS kind, 'exact' AS confidence FROM prj
UNION SELECT s.run_id, 'project:' || s.key, f.id, 'contains', 'exact' FROM ship s JOIN fil f ON f.run_id = s.run_id AND f.path = s.path JOIN prj p ON p.run_id = s.run_id AND p.key = s.key UNION SELECT run_id, from_id, to_id, kind, confidence FROM ed""")
def fact_graph_edges(spark, d):
    """reporting.graph_edges: containment and the ingested edges, distinct."""
    return reporting.graph_edges(table_facts(spark, d))


@query(_FACTS + """, every AS (SELECT run_id, 'file' AS kind, id, parse_filename(path) AS name, path FROM fil UNION ALL SELECT run_id, 'type', id, name, path FROM typ UNION ALL SELECT run_id, 'member', id, name, path FROM mem
UNION ALL SELECT run_id, 'project', id, regexp_replace(parse_filename(path), '\\.[^.]*$', ''), path FROM prj UNION ALL SELECT run_id, 'solution', 'solution:root', 'analysis-root', '.' FROM runs)
SELECT run_id, kind, id, name, path AS file_path FROM every""")
def fact_graph_nodes(spark, d):
    """reporting.graph_nodes: every target with its name and place."""
    return reporting.graph_nodes(table_facts(spark, d)).select(RUN, "kind", "id", "name", "file_path")


@query(_FACTS + """, m AS (SELECT run_id, bool_or(stab = 'semantic') AS s, bool_or(stab <> 'semantic') AS o FROM (SELECT run_id, stab FROM typ UNION ALL SELECT run_id, stab FROM mem) GROUP BY 1),
n AS (SELECT run_id, (SELECT count(*) FROM prj p WHERE p.run_id = r.run_id) AS project_count, (SELECT count(*) FROM fil p WHERE p.run_id = r.run_id) AS file_count, (SELECT count(*) FROM typ p WHERE p.run_id = r.run_id) AS type_count, (SELECT count(*) FROM mem p WHERE p.run_id = r.run_id) AS member_count, (SELECT count(*) FROM val p WHERE p.run_id = r.run_id) AS metric_result_count FROM runs r),
h AS (SELECT run_id, 'sha256:' || sha256(string_agg(path, chr(10) ORDER BY path)) AS source_population_sha256 FROM fil GROUP BY 1)
SELECT n.*, CASE WHEN s AND o THEN 'partial_semantic' WHEN s THEN 'semantic' ELSE 'syntax' END AS mode, source_population_sha256 FROM n LEFT JOIN m ON m.run_id = n.run_id LEFT JOIN h ON h.run_id = n.run_id""")
def fact_summary(spark, d):
    """reporting.summary, analysis_mode and population."""
    parts = _parts(spark, d)
    facts = _facts(spark, d, parts)
    counts = reporting.summary(facts, parts["values"]).select(RUN, "project_count", "file_count", "type_count", "member_count", "metric_result_count")
    return counts.join(reporting.analysis_mode(facts), RUN, "left").join(reporting.population(facts), RUN, "left")


_DECLARED = """WITH raw AS (SELECT DISTINCT run_id, target_id, project_key, file_path, start_line, end_line, chunk_kind FROM chunks WHERE target_id IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL AND end_line >= start_line)"""


def _declared(spark, d, kind: str) -> DataFrame:
    rows = _t(spark, d, "chunks").where("target_id IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL AND end_line >= start_line").where(kind)
    rows = rows.select(RUN, "target_id", "project_key", "file_path", "start_line", "end_line", F.lit(1).alias("start_column")).distinct()
    return rows.withColumn("span", F.struct("file_path", "start_line", "start_column", "end_line"))


@query(_DECLARED + """, t AS (SELECT * FROM raw WHERE chunk_kind = 'type_declaration')
SELECT run_id, target_id, arg_min(file_path, (file_path, start_line)) AS file_path, arg_min(start_line, (file_path, start_line)) AS start_line, sum(end_line - start_line + 1)::INT AS lines_of_code, sum(end_line - start_line)::INT AS token_line_count, count(*) AS parts FROM t GROUP BY 1, 2""")
def fact_types_merged(spark, d):
    """facts.merge_types: declarations of one type as one fact."""
    raw = _declared(spark, d, "chunk_kind = 'type_declaration'").withColumns({"qualified": F.col("target_id"), "token_lines": F.expr("end_line - start_line")})
    none = spark.createDataFrame([], f"{RUN} bigint, parent_type_target_id string")
    merged = fx.merge_types(raw, none)
    return merged.select(RUN, "target_id", "file_path", "start_line", "lines_of_code", "token_line_count", F.size("declarations").cast("bigint").alias("parts"))


@query(_DECLARED + """, t AS (SELECT DISTINCT run_id, target_id, file_path, start_line, end_line, end_line > start_line AS body FROM raw WHERE chunk_kind NOT IN ('type_declaration', 'file_header'))
SELECT run_id, target_id, arg_min(file_path, (NOT body, file_path, start_line)) AS file_path, arg_min(start_line, (NOT body, file_path, start_line)) AS start_line, count(*) AS parts FROM t GROUP BY 1, 2""")
def fact_members_merged(spark, d):
    """facts.merge_members: declarations of one member as one fact, one with a body first."""
    raw = _declared(spark, d, "chunk_kind NOT IN ('type_declaration', 'file_header')")
    flow = F.struct(*[F.lit(0).alias(c) for c in FLOW]).alias("control_flow")
    raw = raw.withColumns({"parent_type_target_id": F.lit("t"), "owner": F.lit("o"), "name": F.lit("n"), "kind": F.lit("member_body"), "has_body": F.expr("end_line > start_line"), "parameter_count": F.lit(0), "control_flow": flow})
    return fx.merge_members(raw).select(RUN, "target_id", "file_path", "start_line", F.size("declarations").cast("bigint").alias("parts"))
