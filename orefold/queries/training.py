"""Queries of the general training-data problems 3, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import drift, references
from orefold.runtime import materialize
from orefold.operators.snapshots import snapshot_changes, untagged

RECORD_KEYS = ("targetId", "metricId")
REF_TABLES = ("graph_edges", "metrics", "chunks")

#: The consistent table of all lines: the fields of the wire schemas by artifact. Their other spellings come from the renames in the files.
METRIC_COLUMNS = {
    "schemaVersion": "string", "metricId": "string", "metricVersion": "string", "targetId": "string", "targetKind": "string",
    "targetIdStability": "string", "valueKind": "string", "numericValue": "double", "unit": "string", "filePath": "string",
    "startLine": "int", "endLine": "int", "tags": "array<string>",
}
MANIFEST_COLUMNS = {
    "schemaVersion": "string", "tool": "string", "toolVersion": "string", "rootPath": "string", "startedAt": "timestamp", "completedAt": "timestamp",
    "durationMs": "bigint", "mode": "string", "input.kind": "string", "input.selectedPath": "string", "input.sourcePopulationSha256": "string",
    "input.options.includeGeneratedCode": "boolean", "input.options.includeChunkText": "boolean", "input.options.syntaxOnly": "boolean",
    "input.options.noRestore": "boolean", "input.options.isolateInput": "boolean", "input.options.top": "int", "artifacts.summary": "string",
    "artifacts.metrics": "string", "artifacts.graph": "string", "artifacts.chunks": "string", "artifacts.diagnostics": "string",
}
ARTIFACT_COLUMNS = {"metrics.ndjson": METRIC_COLUMNS, "manifest.json": MANIFEST_COLUMNS}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    listing = _t(spark, d, "manifest")
    metrics = snapshot_changes(
        _t(spark, d, "metrics").where(untagged()), listing, scope="project_key", snapshot="snapshot_no",
        keys=["target_id", "metric_id"], number="numeric_value",
    )
    digits = F.lower(F.regexp_extract("text_hash", "([0-9A-Fa-f]{64})", 1))
    chunks = snapshot_changes(_t(spark, d, "chunks"), listing, scope="project_key", snapshot="snapshot_no", keys=["chunk_id"], content=[digits])
    return metrics, chunks


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    metrics, chunks = _changes(spark, d)
    a = metrics.select(F.lit("metrics").alias("artifact"), F.concat_ws("|", "target_id", "metric_id").alias("record_id"), "snapshot_no", "change")
    b = chunks.select(F.lit("chunks").alias("artifact"), F.col("chunk_id").alias("record_id"), "snapshot_no", "change")
    return a.unionByName(b)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes per artifact, project and snapshot."""
    metrics, chunks = _changes(spark, d)
    keys = ["project_key", "snapshot_no", "change"]
    both = metrics.select(F.lit("metrics").alias("artifact"), *keys).unionByName(chunks.select(F.lit("chunks").alias("artifact"), *keys))
    return both.groupBy("artifact", *keys).agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    whole = (F.col("artifact") == "manifest.json").alias("whole")  # such a file is one record
    return _t(spark, d, "artifact_lines").select("feed", "artifact", "file_seq", "line_no", "payload", whole)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(_lines(spark, d), RECORD_KEYS, whole="whole")


def _typed(lines: DataFrame, file_keys: list[str]) -> DataFrame:
    """The lines of both artifacts as one table; columns of the other artifact are null."""
    changes = materialize(drift.schema_changes(lines, RECORD_KEYS, whole="whole"), "renames")
    parts = []
    for artifact, columns in ARTIFACT_COLUMNS.items():
        own = lines.where(F.col("artifact") == artifact)
        names = drift.feed_spellings(own, changes, list(columns)).withColumnRenamed("feed", "__feed")
        leaves = drift.load_leaves(own, RECORD_KEYS).drop("payload")
        named = leaves.join(names, F.col("feed").eqNullSafe(F.col("__feed")), "left")
        parts.append(drift.project_typed(named, columns, "names", ["artifact", *file_keys]))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All records of all files as one typed table; repeated lines come out once."""
    rows = _typed(_lines(spark, d), ["feed", "file_seq", "line_no"])
    flat = rows.withColumn("tags", F.array_join(F.array_sort("tags"), ",")).withColumn("failed_casts", F.array_join("failed_casts", ","))
    return flat.withColumn("extra", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("extra"))))).distinct()


def p5_casts(spark: SparkSession, d: str) -> DataFrame:
    """Failed casts per feed, file and field."""
    rows = _typed(_lines(spark, d), ["feed", "file_seq"])
    return rows.select("feed", "file_seq", F.explode("failed_casts").alias("field")).groupBy("feed", "file_seq", "field").agg(F.count("*").alias("n"))


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each file in the consistent table, and how many have a value, or a failed cast, in the columns that go by several names."""
    table = p5_table(spark, d).withColumn("failed", F.split("failed_casts", ","))
    cells = [a for c in SPELLINGS for a in (F.count(c.replace(".", "_")).alias(f"{c.replace('.', '_')}_filled"), F.count_if(F.array_contains("failed", c)).alias(f"{c.replace('.', '_')}_failed"))]
    return table.groupBy("artifact", "feed", "file_seq").agg(F.count("*").alias("n"), *cells)


def _state(spark: SparkSession, d: str) -> DataFrame:
    """The state after two deliveries: what had come by the middle of the nodes' delivery times, then the rest, which brings late parents and references."""
    tables = {t: _t(spark, d, t) for t in ("graph_nodes", *REF_TABLES)}
    ends = F.unix_micros(F.col("delivered_at").cast("timestamp"))
    middle = tables["graph_nodes"].agg(((F.min(ends) + F.max(ends)) / 2).cast("bigint")).first()[0] or 0
    first = F.coalesce(ends < middle, F.lit(False))
    at = lambda df, c: df.select(F.col(c).alias("id"), F.col("snapshot_no").alias("period"))
    state = None
    for these in (first, ~first):
        edges, metrics, chunks, nodes = (tables[t].where(these) for t in (*REF_TABLES, "graph_nodes"))
        ends_of = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"), F.col("snapshot_no").alias("period"))
        related = chunks.select(F.explode("related_target_ids").alias("id"), F.col("snapshot_no").alias("period"))
        refs = {"graph_edges": [ends_of], "metrics": [at(metrics, "target_id")], "chunks": [related]}
        delivered = references.deliveries(at(nodes, "id"), refs, REF_TABLES)
        state = materialize(delivered, "orphans") if state is None else references.advance(state, delivered)
    return state


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = references.orphans(_state(spark, d), REF_TABLES)
    return found.select("ref_table", F.col("period").alias("snapshot_no"), F.col("id").alias("target_id"), "state")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(references.orphans(_state(spark, d), REF_TABLES))


#: Names in the test tables, for the SQL of p5_filled alone: the operator finds them itself.
SPELLINGS = {
    "filePath": ("metrics.ndjson", "VARCHAR", "filePath", "location.filePath", "sourceFile", "path"), "metricVersion": ("metrics.ndjson", "VARCHAR", "metricVersion", "metric_version"),
    "numericValue": ("metrics.ndjson", "DOUBLE", "numericValue", "numeric_value", "result.number", "value"), "startLine": ("metrics.ndjson", "INT", "startLine", "beginLine", "line_start", "location.startLine"),
    "targetIdStability": ("metrics.ndjson", "VARCHAR", "targetIdStability", "idStability", "stability"), "targetKind": ("metrics.ndjson", "VARCHAR", "targetKind", "kind", "target.kind"),
    "unit": ("metrics.ndjson", "VARCHAR", "unit", "measureUnit", "unitName"), "input.kind": ("manifest.json", "VARCHAR", "input.kind", "inputKind"), "rootPath": ("manifest.json", "VARCHAR", "rootPath", "input.root", "root"),
    "toolVersion": ("manifest.json", "VARCHAR", "toolVersion", "build.release"),
}

QUERIES = {"p5_filled": p5_filled, "p3_found": p3_found, "p3_counts": p3_counts, "p5_found": p5_found, "p5_table": p5_table, "p5_casts": p5_casts, "p6_found": p6_found, "p6_counts": p6_counts}

_CURRENT_METRICS = """
cur AS (SELECT project_key, target_id, metric_id, snapshot_no, any_value(numeric_value) AS v, any_value(target_kind) AS target_kind
        FROM (SELECT *, rank() OVER (PARTITION BY target_id, metric_id, snapshot_no ORDER BY delivered_at DESC) AS r
              FROM metrics WHERE coalesce(len(tags), 0) = 0) WHERE r = 1 GROUP BY 1, 2, 3, 4)"""

_P3 = """
WITH pairs AS (SELECT project_key, snapshot_no AS s, lag(snapshot_no) OVER (PARTITION BY project_key ORDER BY snapshot_no) AS b
               FROM (SELECT DISTINCT project_key, snapshot_no FROM manifest)),
m AS (SELECT project_key, target_id || '|' || metric_id AS rid, snapshot_no, max(numeric_value) AS v, count(numeric_value) AS has
      FROM (SELECT *, rank() OVER (PARTITION BY target_id, metric_id, snapshot_no ORDER BY delivered_at DESC) AS r
            FROM metrics WHERE coalesce(len(tags), 0) = 0) WHERE r = 1 GROUP BY 1, 2, 3),
c AS (SELECT project_key, chunk_id AS rid, snapshot_no, max(lower(regexp_extract(text_hash, '([0-9A-Fa-f]{64})', 1))) AS v
      FROM (SELECT *, rank() OVER (PARTITION BY chunk_id, snapshot_no ORDER BY delivered_at DESC) AS r FROM chunks) WHERE r = 1 GROUP BY 1, 2, 3),
mp AS (SELECT p.project_key, p.s, x.rid, x.v, x.has FROM pairs p JOIN m x ON x.project_key = p.project_key AND x.snapshot_no = p.b),
mn AS (SELECT p.project_key, p.s, x.rid, x.v, x.has FROM pairs p JOIN m x ON x.project_key = p.project_key AND x.snapshot_no = p.s AND p.b IS NOT NULL),
cp AS (SELECT p.project_key, p.s, x.rid, x.v FROM pairs p JOIN c x ON x.project_key = p.project_key AND x.snapshot_no = p.b),
cn AS (SELECT p.project_key, p.s, x.rid, x.v FROM pairs p JOIN c x ON x.project_key = p.project_key AND x.snapshot_no = p.s AND p.b IS NOT NULL),
changes AS (
SELECT 'metrics' AS artifact, coalesce(n.project_key, o.project_key) AS project_key, coalesce(n.rid, o.rid) AS record_id, coalesce(n.s, o.s) AS snapshot_no,
       CASE WHEN o.rid IS NULL THEN 'added' WHEN n.rid IS NULL THEN 'removed'
            WHEN o.has = 0 AND n.has = 0 THEN NULL WHEN o.has = 0 OR n.has = 0 THEN 'changed'
            WHEN o.v = n.v THEN NULL
            WHEN isfinite(o.v) AND isfinite(n.v) AND abs(o.v - n.v) <= 1e-9::DOUBLE * greatest(1.0::DOUBLE, abs(o.v), abs(n.v)) THEN NULL
            ELSE 'changed' END AS change
FROM mp o FULL JOIN mn n ON o.project_key = n.project_key AND o.s = n.s AND o.rid = n.rid
UNION ALL
SELECT 'chunks', coalesce(n.project_key, o.project_key), coalesce(n.rid, o.rid), coalesce(n.s, o.s),
       CASE WHEN o.rid IS NULL THEN 'added' WHEN n.rid IS NULL THEN 'removed' WHEN o.v IS DISTINCT FROM n.v THEN 'changed' END
FROM cp o FULL JOIN cn n ON o.project_key = n.project_key AND o.s = n.s AND o.rid = n.rid)
"""

_P6 = """
WITH refs AS (
  SELECT 'graph_edges' AS ref_table, snapshot_no, from_id AS target_id FROM graph_edges UNION
  SELECT 'graph_edges', snapshot_no, to_id FROM graph_edges UNION
  SELECT 'metrics', snapshot_no, target_id FROM metrics UNION
  SELECT 'chunks', snapshot_no, u FROM (SELECT snapshot_no, unnest(related_target_ids) AS u FROM chunks)),
nodes AS (SELECT DISTINCT id, snapshot_no FROM graph_nodes),
span AS (SELECT id, min(snapshot_no) AS lo, max(snapshot_no) AS hi FROM nodes GROUP BY id),
found AS (SELECT r.ref_table, r.snapshot_no, r.target_id,
       CASE WHEN s.lo < r.snapshot_no THEN 'gone' WHEN s.hi > r.snapshot_no THEN 'early' ELSE 'unknown' END AS state
FROM refs r LEFT JOIN span s ON s.id = r.target_id
WHERE r.target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = r.target_id AND n.snapshot_no = r.snapshot_no))
"""

#: Objects three levels deep, as in these feeds; the greedy choice of renames is written as mutual best pairs, which is the same without conflicts.
_P5 = r"""
WITH ok AS (SELECT feed, artifact, file_seq, CASE WHEN json_valid(payload) THEN payload END AS j FROM (SELECT DISTINCT feed, artifact, file_seq, payload FROM artifact_lines)),
rec AS (SELECT feed, file_seq, row_number() OVER () AS rid, j, CASE WHEN artifact = 'manifest.json' THEN '' WHEN coalesce(json_extract_string(j, '$.targetId'), json_extract_string(j, '$.metricId')) IS NOT NULL THEN coalesce(json_extract_string(j, '$.targetId'), '') || '|' || coalesce(json_extract_string(j, '$.metricId'), '') END AS rec FROM ok WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
w AS (SELECT feed, file_seq, rid, rec, k1, json_extract(j, '$."' || k1 || '"') AS v1 FROM (SELECT *, unnest(json_keys(j)) AS k1 FROM rec)),
x AS (SELECT feed, file_seq, rid, rec, k1 || '.' || k2 AS k, json_extract(v1, '$."' || k2 || '"') AS v FROM (SELECT *, unnest(json_keys(v1)) AS k2 FROM w WHERE json_type(v1) = 'OBJECT')
      UNION ALL SELECT feed, file_seq, rid, rec, k1, v1 FROM w WHERE json_type(v1) <> 'OBJECT'),
y AS (SELECT feed, file_seq, rid, rec, k || '.' || k3 AS k, json_extract(v, '$."' || k3 || '"') AS v FROM (SELECT *, unnest(json_keys(v)) AS k3 FROM x WHERE json_type(v) = 'OBJECT')
      UNION ALL SELECT feed, file_seq, rid, rec, k, v FROM x WHERE json_type(v) <> 'OBJECT'),
leaf AS (SELECT feed, file_seq, rec, k AS path, v::VARCHAR AS v, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS t FROM y WHERE json_type(v) <> 'NULL'),
pairs AS (SELECT feed, file_seq AS b, lag(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS a FROM (SELECT DISTINCT feed, file_seq FROM artifact_lines)),
st AS (SELECT feed, file_seq, path, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM leaf GROUP BY 1, 2, 3),
o AS (SELECT p.feed, p.b, s.path, s.types FROM pairs p JOIN st s ON s.feed = p.feed AND s.file_seq = p.a),
n AS (SELECT p.feed, p.b, s.path, s.types FROM pairs p JOIN st s ON s.feed = p.feed AND s.file_seq = p.b WHERE p.a IS NOT NULL),
d AS (SELECT coalesce(o.feed, n.feed) AS feed, coalesce(o.b, n.b) AS b, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.types <> n.types THEN 'retyped' END AS change
      FROM o FULL JOIN n ON o.feed = n.feed AND o.b = n.b AND o.path = n.path),
lv AS (SELECT feed, file_seq, rec, path, list(DISTINCT t || v) AS vs FROM leaf GROUP BY 1, 2, 3, 4),
m AS (SELECT r.feed, r.b, r.path AS x, q.path AS y, avg(list_has_any(lo.vs, ln.vs)::INT) AS share, sum(list_has_any(lo.vs, ln.vs)::INT) AS same
      FROM d r JOIN pairs p ON p.feed = r.feed AND p.b = r.b JOIN d q ON q.feed = r.feed AND q.b = r.b AND q.change = 'added'
      JOIN lv lo ON lo.feed = r.feed AND lo.file_seq = p.a AND lo.path = r.path JOIN lv ln ON ln.feed = r.feed AND ln.file_seq = p.b AND ln.path = q.path AND ln.rec = lo.rec
      WHERE r.change = 'removed' GROUP BY 1, 2, 3, 4 HAVING share > 0.5),
ren AS (SELECT feed, b, x, y FROM (SELECT *, row_number() OVER (PARTITION BY feed, b, x ORDER BY share DESC, same DESC, y) AS i, row_number() OVER (PARTITION BY feed, b, y ORDER BY share DESC, same DESC, x) AS k FROM m) WHERE i = 1 AND k = 1)
SELECT feed, b AS file_seq, 'renamed' AS change, x AS field_before, y AS field_after FROM ren
UNION ALL SELECT d.feed, d.b, change, CASE WHEN change = 'added' THEN '' ELSE path END, CASE WHEN change = 'removed' THEN '' ELSE path END FROM d
WHERE change IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ren WHERE ren.feed = d.feed AND ren.b = d.b AND ((change = 'removed' AND ren.x = d.path) OR (change = 'added' AND ren.y = d.path)))
"""



def _filled_sql() -> str:
    cells = []
    for c, (artifact, kind, *names) in SPELLINGS.items():
        text = f"CASE WHEN artifact = '{artifact}' THEN coalesce({', '.join(f"json_extract_string(j, '$.{n}')" for n in names)}) END"
        out = c.replace(".", "_")
        cells.append(f"count(try_cast({text} AS {kind})) AS {out}_filled, count({text}) - count(try_cast({text} AS {kind})) AS {out}_failed")
    lines = "SELECT DISTINCT artifact, feed, file_seq, line_no, payload AS j FROM artifact_lines WHERE json_valid(payload)"
    return f"SELECT artifact, feed, file_seq, count(*) AS n, {', '.join(cells)} FROM ({lines}) WHERE json_type(j) = 'OBJECT' GROUP BY 1, 2, 3"


SQL = {
    "p5_found": _P5,
    "p5_filled": _filled_sql(),
    "p3_found": _P3 + "SELECT artifact, record_id, snapshot_no, change FROM changes WHERE change IS NOT NULL",
    "p3_counts": _P3 + "SELECT artifact, project_key, snapshot_no, change, count(*) AS n FROM changes WHERE change IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p6_found": _P6 + "SELECT ref_table, snapshot_no, target_id, state FROM found",
    "p6_counts": _P6 + "SELECT ref_table, snapshot_no AS period, state, count(*) AS n FROM found GROUP BY 1, 2, 3",
}
