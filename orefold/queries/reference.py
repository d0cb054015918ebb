"""Queries of the reference's own operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.frontend.lexer import duplication_tokens
from orefold.functions import scalar as fn
from orefold.operators import duplication, graph, intervals
from orefold.operators import relational as rel
from orefold.plans import hotspots, reporting, validate
from orefold.plans.facts import collect_facts, parse_sources
from orefold.plans.metrics import all_metrics
from orefold.runtime import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# lines, scopes, ratios, long rows


def _profile(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where("text IS NOT NULL").withColumn("l", F.split("text", "\n", -1))
    return docs.select("doc_id", "source", F.size("l").alias("lines"), F.size(F.filter("l", lambda x: x.rlike(r"^[ \t\n\x0B\f\r]*$"))).alias("blank_lines"), F.length("text").alias("chars"))


_PROFILE_SQL = """p AS (SELECT doc_id, source, len(l) AS lines, len(list_filter(l, lambda x: regexp_full_match(x, '[ \\t\\n\\v\\f\\r]*'))) AS blank_lines, length(text) AS chars
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""


@query(f"WITH {_PROFILE_SQL} SELECT doc_id, lines::BIGINT AS lines, blank_lines::BIGINT AS blank_lines, (lines - blank_lines)::BIGINT AS filled_lines FROM p")
def line_profile(spark, d):
    p = _profile(spark, d)
    return p.select("doc_id", F.col("lines").cast("bigint").alias("lines"), F.col("blank_lines").cast("bigint").alias("blank_lines"), (F.col("lines") - F.col("blank_lines")).cast("bigint").alias("filled_lines"))


@query(f"""WITH {_PROFILE_SQL}
SELECT 'item' AS level, doc_id::VARCHAR AS target, lines::BIGINT AS lines, blank_lines::BIGINT AS blank_lines, chars::BIGINT AS chars FROM p
UNION ALL SELECT 'scope', source, sum(lines)::BIGINT, sum(blank_lines)::BIGINT, sum(chars)::BIGINT FROM p GROUP BY source
UNION ALL SELECT 'all', 'all', sum(lines)::BIGINT, sum(blank_lines)::BIGINT, sum(chars)::BIGINT FROM p""")
def scope_rollup(spark, d):
    p = _profile(spark, d)
    return rel.scope_rollup(p.drop("source"), p.select("doc_id", "source"), "doc_id", "source", ["lines", "blank_lines", "chars"])


@query("""SELECT o_orderkey, 'discount_share' AS metric_id, sum(l_discount) / o_totalprice AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice <> 0 GROUP BY o_orderkey, o_totalprice
UNION ALL SELECT o_orderkey, 'tax_per_discount', sum(l_tax) / sum(l_discount) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING sum(l_discount) <> 0""")
def ratio_omit_zero(spark, d):
    items = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_discount").alias("discount"), F.sum("l_tax").alias("tax"))
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(items, "o_orderkey")
    return rel.ratios(rows, ["o_orderkey"], {"discount_share": ("discount", "o_totalprice"), "tax_per_discount": ("tax", "discount")})


@query("""SELECT l_orderkey, l_linenumber, 'quantity' AS metric_id, l_quantity AS value FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem""")
def unpivot_metrics(spark, d):
    return rel.unpivot(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"})


@query(f"""WITH cat(metric_id, kinds, vk) AS (VALUES {rel.catalog_values()}),
x AS (SELECT m.*, CASE WHEN c.kinds IS NULL THEN 'unknown metric' WHEN NOT contains(c.kinds, ',' || m.target_kind || ',') THEN 'unsupported target kind' WHEN numeric_value IS NULL THEN 'no number'
  WHEN NOT isfinite(numeric_value) THEN 'not finite' WHEN c.vk = 'integer' AND numeric_value <> trunc(numeric_value) THEN 'fractional integer' END AS problem
  FROM metrics m LEFT JOIN cat c ON c.metric_id = m.metric_id)
SELECT metric_id, target_kind, problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY 1, 2, 3""")
def catalog_check(spark, d):
    return rel.value_violations(_t(spark, d, "metrics").select("metric_id", "target_kind", "numeric_value")).groupBy("metric_id", "target_kind", "problem").agg(F.count("*").alias("n"))


@query(f"""WITH cat(metric_id, kinds, vk) AS (VALUES {rel.catalog_values()})
SELECT m.metric_id, c.vk AS value_kind, count(*) AS n, count(DISTINCT m.target_id) AS targets FROM metrics m JOIN cat c ON c.metric_id = m.metric_id GROUP BY 1, 2""")
def catalog_enrich(spark, d):
    m = _t(spark, d, "metrics").select("metric_id", "target_id", "target_kind", "target_id_stability", "file_path", "start_line", "end_line", "tags", F.col("numeric_value").alias("value"))
    cat = F.broadcast(rel.catalog_frame(spark).select("metric_id", "value_kind"))  # 66 rows
    return m.join(cat, "metric_id").groupBy("metric_id", "value_kind").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets"))


# aggregations


@query("SELECT o_custkey, quantile_disc(o_totalprice, 0.95) AS p95, count(*) AS n FROM orders GROUP BY 1")
def nearest_rank_p95(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.expr("percentile_disc(0.95D) WITHIN GROUP (ORDER BY o_totalprice)").alias("p95"), F.count("*").alias("n"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS nearest, count(*) AS n FROM lineitem GROUP BY 1")
def nearest_rank_large_groups(spark, d):
    return rel.nearest_rank(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 95)


@query("""SELECT c_custkey, coalesce(max(length(o_orderpriority)), 0)::BIGINT AS max_v, coalesce(quantile_disc(length(o_orderpriority), 0.95), 0)::BIGINT AS p95_v
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def max_empty_zero(spark, d):
    measured = rel.max_and_p95(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.length("o_orderpriority").alias("v")), ["c_custkey"], ["v"])
    return rel.zero_filled(_t(spark, d, "customer").select("c_custkey"), ["c_custkey"], measured, ["max_v", "p95_v"])


@query("SELECT c_custkey, coalesce(sum(length(o_orderpriority)), 0)::BIGINT AS weighted, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def weighted_sum_per_parent(spark, d):
    per = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.length("o_orderpriority")).alias("weighted"), F.count("*").alias("n"))
    return rel.zero_filled(_t(spark, d, "customer").select("c_custkey"), ["c_custkey"], per, ["weighted", "n"])


@query("SELECT file_path, kind, count(*) AS n FROM graph_nodes GROUP BY 1, 2")
def count_per_group(spark, d):
    return _t(spark, d, "graph_nodes").groupBy("file_path", "kind").agg(F.count("*").alias("n"))


@query("SELECT file_path, count(DISTINCT (start_line, end_line)) AS n FROM graph_nodes WHERE kind = 'type' AND start_line IS NOT NULL AND end_line IS NOT NULL GROUP BY 1")
def distinct_composite(spark, d):
    types = _t(spark, d, "graph_nodes").where("kind = 'type' AND start_line IS NOT NULL AND end_line IS NOT NULL")
    return types.select("file_path", "start_line", "end_line").distinct().groupBy("file_path").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT snapshot_no, from_id, to_id FROM graph_edges WHERE kind = 'calls' AND from_id IS NOT NULL AND to_id IS NOT NULL),
n AS (SELECT DISTINCT id FROM graph_nodes WHERE kind = 'member'), d AS (SELECT DISTINCT from_id, to_id FROM e)
SELECT n.id AS id, (SELECT count(*) FROM d WHERE from_id = n.id) AS fan_out, (SELECT count(*) FROM d WHERE to_id = n.id) AS fan_in FROM n""")
def fan_out_in(spark, d):
    edges = _t(spark, d, "graph_edges").where("kind = 'calls' AND from_id IS NOT NULL AND to_id IS NOT NULL")
    return rel.distinct_degrees(edges, _t(spark, d, "graph_nodes").where("kind = 'member'").select("id").distinct(), "id")


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey)
SELECT a AS from_id, b AS to_id FROM e""")
def fan_out_lifted(spark, d):
    """Supplier to customer trade lifted to their nations; edges within one nation are left out."""
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("to_id"))
    edges = _t(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("from_id")).join(orders, "l_orderkey")
    parents = _t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")).unionByName(
        _t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("nation")))
    return rel.lifted_edges(edges, parents, "id", "nation")


@query("""SELECT kind, snapshot_no, count(*) AS n FROM graph_edges e WHERE from_id IN (SELECT id FROM graph_nodes) AND to_id IN (SELECT id FROM graph_nodes) GROUP BY 1, 2""")
def edge_semi_join(spark, d):
    kept = rel.with_known_ends(_t(spark, d, "graph_edges").select("kind", "snapshot_no", "from_id", "to_id"), _t(spark, d, "graph_nodes"), "id")
    return kept.groupBy("kind", "snapshot_no").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_per_group(spark, d):
    return rel.first_per_group(_t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT target_id, snapshot_no, sum(lines)::BIGINT AS lines, count(*) AS parts, min(file_path) AS file_path FROM
(SELECT DISTINCT target_id, snapshot_no, file_path, start_line, end_line, end_line - start_line + 1 AS lines FROM chunks WHERE chunk_kind = 'type_declaration' AND end_line >= start_line) GROUP BY 1, 2""")
def primary_row_merge(spark, d):
    """Declarations of one type merged: summed lines and the first file by path."""
    parts = _t(spark, d, "chunks").where("chunk_kind = 'type_declaration' AND end_line >= start_line").select("target_id", "snapshot_no", "file_path", "start_line", "end_line").distinct()
    return parts.groupBy("target_id", "snapshot_no").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.count("*").alias("parts"), F.min("file_path").alias("file_path"))


@query("SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS members FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def namespace_group(spark, d):
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("members"))


# intervals and tags


@query("""WITH nodes AS (SELECT DISTINCT project_key, snapshot_no, id, file_path, start_line, end_line FROM graph_nodes WHERE kind IN ('type', 'member') AND start_line IS NOT NULL AND end_line IS NOT NULL AND file_path IS NOT NULL AND start_line <= end_line),
marks AS (SELECT DISTINCT project_key, snapshot_no, file_path, chunk_id, start_line, end_line FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND start_line <= end_line AND file_path IS NOT NULL)
SELECT n.project_key, n.snapshot_no, n.id, count(DISTINCT m.chunk_id) AS n FROM nodes n LEFT JOIN marks m ON m.project_key = n.project_key AND m.snapshot_no = n.snapshot_no AND m.file_path = n.file_path AND m.start_line <= n.end_line AND m.end_line >= n.start_line
GROUP BY 1, 2, 3""")
def interval_overlap_count(spark, d):
    """Chunks that overlap each type and member, counted once each."""
    ok = "start_line IS NOT NULL AND end_line IS NOT NULL AND file_path IS NOT NULL AND start_line <= end_line"
    span = lambda df, *c: df.where(ok).select("project_key", "snapshot_no", "file_path", *c, F.col("start_line").alias("start"), F.col("end_line").alias("end")).distinct()
    nodes = span(_t(spark, d, "graph_nodes").where("kind IN ('type', 'member')"), "id")
    return intervals.overlap_counts(nodes, ["project_key", "snapshot_no", "id"], span(_t(spark, d, "chunks"), "chunk_id"), "chunk_id", ["project_key", "snapshot_no", "file_path"])


@query("""SELECT target_id, NULL AS tag, count(*) AS n FROM metrics WHERE metric_id = 'diagnostic_count' GROUP BY 1
UNION ALL SELECT target_id, tag, count(*) FROM (SELECT target_id, unnest(list_distinct(tags)) AS tag FROM metrics WHERE metric_id = 'diagnostic_count') GROUP BY 1, 2""")
def tag_slices(spark, d):
    return rel.tag_slices(_t(spark, d, "metrics").where("metric_id = 'diagnostic_count'").select("target_id", "tags"), ["target_id"], "tags")


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY 1""")
def merge_tags(spark, d):
    merged = rel.merged_tags(_t(spark, d, "events").select("user_id", F.array("event_type").alias("tags")), ["user_id"], "tags")
    return merged.select("user_id", F.array_join("tags", ",").alias("tags"))


@query("""SELECT snapshot_no, target_id, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT snapshot_no, target_id, unnest(tags) AS t FROM metrics) GROUP BY 1, 2""")
def tag_union(spark, d):
    merged = rel.merged_tags(_t(spark, d, "metrics").where("tags IS NOT NULL").select("snapshot_no", "target_id", "tags"), ["snapshot_no", "target_id"], "tags")
    return merged.where("tags IS NOT NULL").select("snapshot_no", "target_id", F.array_join("tags", ",").alias("tags"))


# ranking


@query("SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 0.0::DOUBLE ELSE cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) END AS percentile FROM supplier")
def ecdf_percentile(spark, d):
    return rel.ecdf(_t(spark, d, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", "percentile")


_RANK_SQL = """WITH long AS (
  SELECT 'supplier' AS kind, 's' || s_suppkey AS id, 'balance' AS metric, s_acctbal AS v FROM supplier UNION ALL
  SELECT 'customer', 'c' || c_custkey, 'balance', c_acctbal FROM customer UNION ALL
  SELECT 'customer', 'c' || o_custkey, 'orders', count(*)::DOUBLE FROM orders GROUP BY o_custkey UNION ALL
  SELECT 'part', 'p' || p_partkey, 'price', p_retailprice FROM part UNION ALL SELECT 'part', 'p' || p_partkey, 'size', p_size::DOUBLE FROM part),
w(kind, metric, weight) AS (VALUES ('supplier', 'balance', 1.0::DOUBLE), ('customer', 'balance', 0.3::DOUBLE), ('customer', 'orders', 0.7::DOUBLE), ('part', 'price', 0.75::DOUBLE), ('part', 'size', 0.25::DOUBLE)),
p AS (SELECT long.kind, long.id, weight, round(CASE WHEN v <= 0 THEN 0.0::DOUBLE ELSE cume_dist() OVER (PARTITION BY long.kind, long.metric ORDER BY v) END, 6) AS pct FROM long JOIN w ON w.kind = long.kind AND w.metric = long.metric),
s AS (SELECT kind, id, round(sum(pct * weight) / sum(weight), 6) AS score FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, kind, id) AS rank_no FROM s)"""


def _scored(spark, d):
    c = lambda df, kind, pre, key, metric, v: df.select(F.lit(kind).alias("kind"), F.concat(F.lit(pre), key).alias("id"), F.lit(metric).alias("metric"), F.col(v).cast("double").alias("v"))
    orders = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    part = _t(spark, d, "part")
    long = rel.union_all([
        c(_t(spark, d, "supplier"), "supplier", "s", "s_suppkey", "balance", "s_acctbal"), c(_t(spark, d, "customer"), "customer", "c", "c_custkey", "balance", "c_acctbal"),
        c(orders, "customer", "c", "o_custkey", "orders", "n"), c(part, "part", "p", "p_partkey", "price", "p_retailprice"), c(part, "part", "p", "p_partkey", "size", "p_size"),
    ])
    weights = spark.createDataFrame([("supplier", "balance", 1.0), ("customer", "balance", 0.3), ("customer", "orders", 0.7), ("part", "price", 0.75), ("part", "size", 0.25)], "kind string, metric string, weight double")
    weighted = long.join(F.broadcast(weights), ["kind", "metric"])  # five rows
    pct = rel.ecdf(weighted, ["kind", "metric"], "v").withColumn("percentile", F.round("percentile", 6))
    return pct.groupBy("kind", "id").agg(F.round(F.sum(F.col("percentile") * F.col("weight")) / F.sum("weight"), 6).alias("score"))


_BY_SCORE = lambda: [-F.col("score"), F.col("kind"), F.col("id")]


@query(_RANK_SQL + " SELECT kind, id, score, rank_no FROM r")
def hotspot_rank(spark, d):
    return rel.global_rank(_scored(spark, d), _BY_SCORE())


@query(_RANK_SQL + " SELECT kind, id, score, rank_no FROM r WHERE score > 0 ORDER BY rank_no LIMIT 20")
def hotspot_topk(spark, d):
    return rel.top_ranked(_scored(spark, d).where("score > 0"), _BY_SCORE(), 20)


# duplication

MIN_TOKENS, MIN_LINES = 50, 2

_WINDOWS_SQL = """WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
toks AS (SELECT doc_id, line_no, generate_subscripts(w, 1) AS k, unnest(w) AS tok FROM (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS w FROM lines)),
pos AS (SELECT doc_id, line_no, tok, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS pos FROM toks),
win AS (SELECT doc_id, pos, line_no AS a, lead(line_no, 49) OVER o AS b, md5(string_agg(tok, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
q AS (SELECT * FROM win WHERE b IS NOT NULL AND b - a + 1 >= 2),
k AS (SELECT h, min(doc_id) AS f0, max(doc_id) AS f1, min(pos) AS p0, max(pos) AS p1 FROM q GROUP BY h),
rep AS (SELECT q.*, f0 <> f1 AS across_files FROM q JOIN k ON q.h = k.h WHERE f0 <> f1 OR pos - p0 >= 50 OR p1 - pos >= 50)"""


def _repeated(spark, d):
    windows = duplication.token_windows(_t(spark, d, "documents"), "doc_id", "text", duplication.word_tokens, MIN_TOKENS, MIN_LINES)
    return duplication.repeated_windows(windows, MIN_TOKENS)


@query(_WINDOWS_SQL + " SELECT doc_id AS file, across_files, count(*) AS n FROM rep GROUP BY 1, 2")
def repeated_windows(spark, d):
    return _repeated(spark, d).groupBy("file", "across_files").agg(F.count("*").alias("n"))


_REGION_SQL = _WINDOWS_SQL + """, isl AS (SELECT *, sum(CASE WHEN pos - prev < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM rep)),
reg AS (SELECT doc_id, g, min(pos) AS s, max(pos) + 50 AS e, min(a) AS start_line, max(b) AS end_line FROM isl GROUP BY 1, 2)"""


@query(_REGION_SQL + " SELECT doc_id AS file, s::BIGINT AS start, e::BIGINT AS \"end\", start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM reg")
def duplicate_regions(spark, d):
    r = duplication.duplicated_regions(_repeated(spark, d), MIN_TOKENS)
    return r.select("file", *[F.col(c).cast("bigint").alias(c) for c in ("start", "end", "start_line", "end_line")])


@query(_REGION_SQL + " SELECT doc_id AS file, count(DISTINCT x) AS duplicated_line_count FROM (SELECT doc_id, unnest(generate_series(start_line, end_line)) AS x FROM reg) GROUP BY 1")
def duplicate_line_union(spark, d):
    return duplication.duplicated_lines(duplication.duplicated_regions(_repeated(spark, d), MIN_TOKENS))


@query(_REGION_SQL + " SELECT doc_id AS file, s::BIGINT AS start, printf('duplication_block:%06d', row_number() OVER (ORDER BY doc_id, s)) AS tag FROM reg")
def duplicate_tags(spark, d):
    return duplication.with_tags(duplication.duplicated_regions(_repeated(spark, d), MIN_TOKENS)).select("file", F.col("start").cast("bigint").alias("start"), "tag")


# graphs

_DEP = "kind IN ('inherits', 'implements', 'uses_type')"


def _dep_graph(spark, d, where):
    edges = _t(spark, d, "graph_edges").where(where).where("from_id IS NOT NULL AND to_id IS NOT NULL").select("project_key", "snapshot_no", "from_id", "to_id")
    return edges, edges.select("project_key", "snapshot_no", F.explode(F.array("from_id", "to_id")).alias("node"))


_CLOSURE_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT project_key AS p, snapshot_no AS s, from_id AS a, to_id AS b FROM graph_edges WHERE {where} AND from_id IS NOT NULL AND to_id IS NOT NULL),
c AS (SELECT p, s, a, b FROM e UNION SELECT c.p, c.s, c.a, e.b FROM c JOIN e ON e.p = c.p AND e.s = c.s AND e.a = c.b),
n AS (SELECT p, s, a AS node FROM e UNION SELECT p, s, b FROM e)"""


@query(_CLOSURE_SQL.format(where=_DEP) + """ SELECT n.p AS project_key, n.s AS snapshot_no, n.node, count(x.b) FILTER (x.b <> n.node) AS reachable FROM n LEFT JOIN c x ON x.p = n.p AND x.s = n.s AND x.a = n.node GROUP BY 1, 2, 3""")
def reach_counts(spark, d):
    edges, nodes = _dep_graph(spark, d, _DEP)
    return graph.graph_measures(edges, nodes, ["project_key", "snapshot_no"]).select("project_key", "snapshot_no", "node", "reachable")


@query(_CLOSURE_SQL.format(where=_DEP) + """ SELECT n.p AS project_key, n.s AS snapshot_no, n.node, count(x.a) FILTER (x.a <> n.node) AS dependents FROM n LEFT JOIN c x ON x.p = n.p AND x.s = n.s AND x.b = n.node GROUP BY 1, 2, 3""")
def dependent_counts(spark, d):
    edges, nodes = _dep_graph(spark, d, _DEP)
    return graph.graph_measures(edges, nodes, ["project_key", "snapshot_no"]).select("project_key", "snapshot_no", "node", "dependents")


@query(_CLOSURE_SQL.format(where="kind = 'calls'") + """ SELECT n.p AS project_key, n.s AS snapshot_no, n.node, count(y.a) AS cyclic_size FROM n LEFT JOIN c x ON x.p = n.p AND x.s = n.s AND x.a = n.node
LEFT JOIN c y ON y.p = x.p AND y.s = x.s AND y.a = x.b AND y.b = x.a GROUP BY 1, 2, 3""")
def scc_size(spark, d):
    edges, nodes = _dep_graph(spark, d, "kind = 'calls'")
    return graph.graph_measures(edges, nodes, ["project_key", "snapshot_no"], reach=False).select("project_key", "snapshot_no", "node", "cyclic_size")


@query("""SELECT DISTINCT 'solution:root' AS from_id, 'region:' || r_regionkey AS to_id, 'contains' AS kind FROM region UNION ALL SELECT DISTINCT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'contains' FROM nation
UNION ALL SELECT DISTINCT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains' FROM supplier UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer""")
def structural_edges(spark, d):
    e = lambda df, a, ak, b, bk: df.select(F.concat(F.lit(a), ak).alias("from_id") if ak else F.lit(a).alias("from_id"), F.concat(F.lit(b), bk).alias("to_id"), F.lit("contains").alias("kind"))
    return rel.union_all([
        e(_t(spark, d, "region"), "solution:root", None, "region:", "r_regionkey"), e(_t(spark, d, "nation"), "region:", "n_regionkey", "nation:", "n_nationkey"),
        e(_t(spark, d, "supplier"), "nation:", "s_nationkey", "supplier:", "s_suppkey"), e(_t(spark, d, "customer"), "nation:", "c_nationkey", "customer:", "c_custkey"),
    ]).distinct()


@query("""SELECT kind, name, count(DISTINCT id) AS targets FROM graph_nodes GROUP BY 1, 2""")
def graph_nodes_report(spark, d):
    return _t(spark, d, "graph_nodes").select("kind", "name", "id").distinct().groupBy("kind", "name").agg(F.count("id").alias("targets"))


# chunks, identities, paths


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0::DOUBLE)) END::BIGINT AS token_estimate,
'sha256:' || sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL""")
def chunk_rows(spark, d):
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", fn.token_estimate(F.col("text")).cast("bigint").alias("token_estimate"), fn.text_hash(F.col("text")).alias("text_hash"))


@query("""SELECT o_custkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS related FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def related_ids(spark, d):
    pairs = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(_t(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey")
    distinct = pairs.select("o_custkey", F.col("l_suppkey").cast("string").alias("s")).distinct()
    return distinct.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias("related"))


@query("""SELECT run_id, sha256(string_agg(DISTINCT file_path, chr(10) ORDER BY file_path)) AS population_sha256 FROM graph_nodes WHERE file_path IS NOT NULL GROUP BY 1""")
def population_hash(spark, d):
    return rel.population_hash(_t(spark, d, "graph_nodes"), ["run_id"], "file_path")


@query("""SELECT DISTINCT project_path, project_key, left(sha256(project_path), 16) AS computed_key, 'project:' || left(sha256(project_path), 16) AS target_id FROM manifest WHERE project_path IS NOT NULL""")
def stable_ids(spark, d):
    p = F.col("project_path")
    return _t(spark, d, "manifest").where("project_path IS NOT NULL").select("project_path", "project_key", fn.project_key(p).alias("computed_key"), fn.project_id(p).alias("target_id")).distinct()


@query(r"""SELECT DISTINCT file_path FROM graph_nodes WHERE file_path IS NOT NULL AND regexp_matches(file_path, '^src/(?:.*/)?[^/]*\.cs$') AND NOT regexp_matches(file_path, '^(?:.*/)?[^/]*\.g\.cs$')""")
def glob_filter(spark, d):
    paths = _t(spark, d, "graph_nodes").select("file_path").where("file_path IS NOT NULL").distinct()
    return paths.where(fn.glob_filter(F.col("file_path"), ["src/**/*.cs"], ["**/*.g.cs"]))


@query(r"""WITH dirs AS (SELECT DISTINCT regexp_extract(project_path, '^(.*)/[^/]*$', 1) AS dir FROM manifest WHERE project_path IS NOT NULL),
paths AS (SELECT DISTINCT file_path FROM graph_nodes WHERE file_path IS NOT NULL),
hits AS (SELECT file_path, dir, row_number() OVER (PARTITION BY file_path ORDER BY length(dir) DESC) AS r FROM paths JOIN dirs ON starts_with(file_path, dir || '/') OR dir = '')
SELECT p.file_path, h.dir FROM paths p LEFT JOIN hits h ON h.file_path = p.file_path AND h.r = 1""")
def longest_prefix(spark, d):
    dirs = _t(spark, d, "manifest").where("project_path IS NOT NULL").select(fn.directory(F.col("project_path")).alias("dir")).distinct()
    return rel.longest_prefix(_t(spark, d, "graph_nodes").select("file_path").where("file_path IS NOT NULL").distinct(), "file_path", dirs, "dir")


@query("""SELECT id FROM graph_nodes WHERE file_path IS NOT NULL GROUP BY id HAVING bool_and(regexp_matches(file_path, '^src/.*$')) AND NOT bool_or(regexp_matches(file_path, '^(?:.*/)?[^/]*\\.g\\.cs$'))""".replace("\\\\", "\\"))
def selector_all_any(spark, d):
    paths = _t(spark, d, "graph_nodes").where("file_path IS NOT NULL").select("id", "file_path").distinct().groupBy("id").agg(F.collect_list("file_path").alias("paths"))
    return paths.where(fn.paths_selected(F.col("paths"), ["src/**"], ["**/*.g.cs"])).select("id")


# integrity


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def dangling_refs(spark, d):
    parents = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return rel.dangling(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], parents)


@query("SELECT run_id, id, count(*) AS n FROM graph_nodes GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return rel.duplicate_keys(_t(spark, d, "graph_nodes"), ["run_id", "id"])


@query("""SELECT run_id, count(DISTINCT id) FILTER (kind = 'project') AS projects, count(DISTINCT id) FILTER (kind = 'file') AS files, count(DISTINCT id) FILTER (kind = 'type') AS types, count(DISTINCT id) FILTER (kind = 'member') AS members FROM graph_nodes GROUP BY 1""")
def summary_counts(spark, d):
    nodes = _t(spark, d, "graph_nodes").select("run_id", "kind", "id").where("id IS NOT NULL").distinct()
    return nodes.groupBy("run_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("project", "file", "type", "member")])


# scoring

#: The debt of every snapshot over all finite values.
_DEBT_SQL = """WITH lim(metric_id, maximum, weight) AS (VALUES ('cyclomatic_complexity', 10.0::DOUBLE, 2.0::DOUBLE), ('member_length', 60.0::DOUBLE, 1.0::DOUBLE)),
g AS (SELECT snapshot_no, target_id, sum(greatest(0.0::DOUBLE, numeric_value - maximum) * weight) AS gap FROM (SELECT DISTINCT target_id, metric_id, snapshot_no, numeric_value FROM metrics WHERE coalesce(len(tags), 0) = 0 AND isfinite(numeric_value)) m JOIN lim ON lim.metric_id = m.metric_id GROUP BY 1, 2),
r AS (SELECT snapshot_no, sum(gap) AS gap_sum, sum(gap * gap) AS squared_gap_sum, count(*) FILTER (gap > 0) AS violating_targets, max(gap) AS max_target_gap FROM g GROUP BY 1)"""


def _debt(spark, d):
    limits = F.broadcast(spark.createDataFrame([("cyclomatic_complexity", 10.0, 2.0), ("member_length", 60.0, 1.0)], "metric_id string, maximum double, weight double"))  # two rows
    v = F.col("numeric_value")
    rows = _t(spark, d, "metrics").where((F.coalesce(F.size("tags"), F.lit(0)) <= 0) & fn.is_finite(v) & ~F.isnan(v))
    return rel.threshold_debt(rows.select("snapshot_no", "target_id", "metric_id", v.alias("value")).distinct(), limits, by=["snapshot_no"])


@query(_DEBT_SQL + " SELECT * FROM r")
def threshold_debt(spark, d):
    return _debt(spark, d)


@query(_DEBT_SQL + " SELECT snapshot_no, gap_sum + 0.001::DOUBLE * squared_gap_sum AS score FROM r")
def weighted_score(spark, d):
    return _debt(spark, d).select("snapshot_no", (F.col("gap_sum") + F.col("squared_gap_sum") * 0.001).alias("score"))


# sets, unions, modes, json


@query("SELECT DISTINCT target_id_stability FROM metrics WHERE target_id_stability NOT IN ('semantic')")
def set_membership_diff(spark, d):
    return _t(spark, d, "metrics").select("target_id_stability").distinct().where(~F.col("target_id_stability").isin("semantic"))


@query("SELECT target_id, metric_id, count(*) AS n FROM metrics WHERE list_sort(tags) = ['compiler', 'nullable'] GROUP BY 1, 2")
def tag_set_equality(spark, d):
    wanted = F.array_sort(F.array(F.lit("nullable"), F.lit("compiler")))
    return _t(spark, d, "metrics").where(F.array_sort("tags") == wanted).groupBy("target_id", "metric_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events")
def json_value_kind(spark, d):
    k = F.get_json_object("props", "$.k")
    return _t(spark, d, "events").select("event_id", k.try_cast("bigint").alias("k"), k.isNotNull().alias("has_k"))


@query("""SELECT CASE WHEN value_kind = 'number' THEN 'number' ELSE coalesce(value_kind, '') END AS value_kind, (numeric_value IS NOT NULL)::INT + (string_value IS NOT NULL)::INT + (bool_value IS NOT NULL)::INT AS present, count(*) AS n FROM metrics GROUP BY 1, 2""")
def tagged_union(spark, d):
    present = F.col("numeric_value").isNotNull().cast("int") + F.col("string_value").isNotNull().cast("int") + F.col("bool_value").isNotNull().cast("int")
    return _t(spark, d, "metrics").select(F.coalesce("value_kind", F.lit("")).alias("value_kind"), present.alias("present")).groupBy("value_kind", "present").agg(F.count("*").alias("n"))


@query("""SELECT run_id, CASE WHEN bool_or(target_id_stability = 'semantic') AND bool_or(target_id_stability <> 'semantic') THEN 'partial_semantic' WHEN bool_or(target_id_stability = 'semantic') THEN 'semantic' ELSE 'syntax' END AS mode FROM graph_nodes WHERE kind IN ('type', 'member') GROUP BY 1""")
def mode_case(spark, d):
    semantic = F.bool_or(F.col("target_id_stability") == "semantic")
    other = F.bool_or(F.col("target_id_stability") != "semantic")
    runs = _t(spark, d, "graph_nodes").where("kind IN ('type', 'member')").groupBy("run_id").agg(semantic.alias("s"), other.alias("o"))
    return runs.select("run_id", F.when(F.col("s") & F.col("o"), "partial_semantic").when(F.col("s"), "semantic").otherwise("syntax").alias("mode"))


@query("""SELECT run_id, greatest(0, epoch_ms(completed_at) - epoch_ms(started_at))::BIGINT AS computed_ms FROM manifest WHERE completed_at IS NOT NULL""")
def durations(spark, d):
    at = lambda c: F.col(c).cast("timestamp")
    return _t(spark, d, "manifest").where("completed_at IS NOT NULL").select("run_id", fn.duration_ms(at("started_at"), at("completed_at")).alias("computed_ms"))


@query("""SELECT DISTINCT regexp_replace(file_path, '^.*/', '') AS name, lower(file_path) LIKE '%.g.cs' OR lower(file_path) LIKE '%.generated.cs' OR lower(file_path) LIKE '%.designer.cs' OR lower(regexp_replace(file_path, '^.*/', '')) = 'assemblyinfo.cs' AS generated FROM graph_nodes WHERE file_path IS NOT NULL""")
def generated_files(spark, d):
    p = F.col("file_path")
    return _t(spark, d, "graph_nodes").where("file_path IS NOT NULL").select(fn.file_name(p).alias("name"), fn.is_generated(p).alias("generated")).distinct()


@query("""SELECT DISTINCT from_id, to_id, kind, confidence FROM graph_edges""")
def distinct_edges(spark, d):
    return _t(spark, d, "graph_edges").select("from_id", "to_id", "kind", "confidence").distinct()


@query("""WITH f AS (SELECT DISTINCT run_id, id, file_path, start_line, end_line FROM graph_nodes WHERE kind = 'file' AND file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
t AS (SELECT run_id, file_path, min(start_line) AS first FROM graph_nodes WHERE kind = 'type' GROUP BY 1, 2)
SELECT f.run_id, f.id, least(f.end_line, greatest(f.start_line, coalesce(t.first, f.end_line + 1) - 1)) AS header_end FROM f LEFT JOIN t ON t.run_id = f.run_id AND t.file_path = f.file_path""")
def header_spans(spark, d):
    nodes = _t(spark, d, "graph_nodes")
    files = nodes.where("kind = 'file' AND file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL").select("run_id", "id", "file_path", "start_line", "end_line").distinct()
    first = nodes.where("kind = 'type'").groupBy("run_id", "file_path").agg(F.min("start_line").alias("first"))
    end = F.least("end_line", F.greatest("start_line", F.coalesce("first", F.col("end_line") + 1) - 1))
    return files.join(first, ["run_id", "file_path"], "left").select("run_id", "id", end.alias("header_end"))


# the C# front end over the documents that are C# sources; SQL can't lex, so tests compare with counts by hand


def _csharp(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    key = F.lower(F.regexp_replace("source", r"[^\p{L}]", ""))
    return docs.where(key == "sourcefiles").select(F.coalesce("project_key", F.lit("none")).alias("run_id"), F.format_string("%d.cs", "doc_id").alias("file_path"), "text")


@query()
def csharp_lines(spark, d):
    parsed = parse_sources(_csharp(spark, d))
    return parsed.select("run_id", "file_path", "lines.*")


@query()
def csharp_members(spark, d):
    m = parse_sources(_csharp(spark, d)).select("run_id", "file_path", "types", F.explode("members").alias("m"))
    return m.select("run_id", "file_path", F.col("types")[F.col("m.n")]["qualified"].alias("type"), "m.name", "m.kind", "m.start_line", "m.end_line", "m.parameter_count", "m.control_flow.*")


@query()
def csharp_duplication(spark, d):
    windows = duplication.token_windows(_csharp(spark, d), "file_path", "text", duplication_tokens)
    return duplication.duplicated_lines(duplication.duplicated_regions(duplication.repeated_windows(windows)))


@query()
def syntax_run_metrics(spark, d):
    """Every metric of a syntax-only analysis of each project's C# documents, ranking included."""
    facts = collect_facts(spark, _csharp(spark, d))
    metrics = materialize(all_metrics(facts), "metrics")
    ranked = hotspots.rank(hotspots.candidates(facts), metrics, facts.health)
    return rel.union_all([metrics, hotspots.rank_metrics(ranked)]).select("run_id", "metric_id", "target_kind", "target_id", "numeric_value", F.array_join("tags", ",").alias("tags"))


# validation over delivered runs


def _nodes(spark, d):
    return _t(spark, d, "graph_nodes").select("run_id", "id", "kind", "name", "target_id_stability", "file_path").distinct()


@query("""WITH ids AS (SELECT DISTINCT run_id, id FROM graph_nodes), ends AS (SELECT run_id, from_id AS id FROM graph_edges UNION SELECT run_id, to_id FROM graph_edges)
SELECT e.run_id, count(*) AS n FROM ends e WHERE e.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.run_id = e.run_id AND ids.id = e.id) GROUP BY 1""")
def missing_edge_ends(spark, d):
    found = validate.edge_violations(_t(spark, d, "graph_edges"), _nodes(spark, d)).where("rule = 'missing edge end'")
    return found.groupBy("run_id").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT run_id, id, any_value(kind) AS kind, any_value(target_id_stability) AS s FROM graph_nodes GROUP BY 1, 2),
m AS (SELECT DISTINCT run_id, target_id, target_kind, target_id_stability FROM metrics)
SELECT m.run_id, CASE WHEN k.kind IS NULL THEN 'missing node' WHEN m.target_kind <> k.kind THEN 'target kind' ELSE 'target id stability' END AS rule, count(*) AS n
FROM m LEFT JOIN k ON k.run_id = m.run_id AND k.id = m.target_id WHERE k.kind IS NULL OR m.target_kind <> k.kind OR m.target_id_stability <> k.s GROUP BY 1, 2""")
def target_mismatches(spark, d):
    found = validate.target_violations(_t(spark, d, "metrics"), _nodes(spark, d), "metrics")
    return found.groupBy("run_id", "rule").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT run_id, target_id, metric_id, metric_version, coalesce(array_to_string(list_sort(tags), ','), '') AS t, count(*) AS n FROM metrics GROUP BY ALL)
SELECT run_id, count(*) AS n FROM k WHERE n > 1 GROUP BY 1""")
def duplicate_observations(spark, d):
    m = _t(spark, d, "metrics").withColumn("t", F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ","))
    return rel.duplicate_keys(m, ["run_id", "target_id", "metric_id", "metric_version", "t"]).groupBy("run_id").agg(F.count("*").alias("n"))


# the wire form


@query("SELECT file_path, start_line, end_line, target_id FROM metrics")
def ndjson_round_trip(spark, d):
    """Rows written as wire JSON and read back under the fixed schema."""
    kept = ["target_id", "file_path", "start_line", "end_line"]
    rows = _t(spark, d, "metrics").select(*kept)
    text = reporting.wire(rows).select(F.to_json(F.struct("*")).alias("value"))
    back = text.select(F.from_json("value", "targetId string, filePath string, startLine int, endLine int", {"mode": "FAILFAST"}).alias("v"))
    return back.select(F.col("v.targetId").alias("target_id"), F.col("v.filePath").alias("file_path"), F.col("v.startLine").alias("start_line"), F.col("v.endLine").alias("end_line"))
