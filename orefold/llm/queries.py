"""Queries of the language-model problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.llm import chunking, mixing, percentiles, pii, ranking
from orefold.llm.tokenizer import decode_column, encode_column
from orefold.operators.snapshots import current_rows, untagged
from orefold.runtime import split_hot


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# 1: oversized chunks


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(_t(spark, d, "chunks"))


def p1_whole(spark: SparkSession, d: str) -> DataFrame:
    """Each cut chunk put together again from its pieces without what they share, with what must hold for them."""
    pieces = p1_pieces(spark, d).withColumn("core", F.struct("piece_no", F.expr("substring(text, shared_chars + 1)").alias("t")))
    per = pieces.groupBy("chunk_id", "snapshot_no", "chunk_kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("core")), lambda c: c["t"]), "").alias("t"), F.max("n_tokens").alias("most"), F.count("*").alias("n"), F.max("n_pieces").alias("said"),
        F.sum(F.col("n_tokens") - F.col("shared_tokens")).alias("tokens"), F.max((F.col("piece_no") > 0) & (F.col("shared_tokens") == 0)).alias("bare"), F.count("text").alias("texts"),
    )
    fits = (F.col("most") <= chunking.MAX_TOKENS) & (F.col("n") == F.col("said")) & ~F.col("bare")
    return per.select("chunk_id", "snapshot_no", "chunk_kind", fits.alias("fits"), F.when(F.col("texts") > 0, F.md5("t")).alias("text_md5"), F.when(F.col("texts") == 0, F.col("tokens")).alias("tokens"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that were cut, from their first pieces."""
    return p1_pieces(spark, d).where("piece_no = 0 AND n_pieces > 1").select("chunk_id", "snapshot_no")


# 2: one ranking per run

_GROUP = ["run_id", "target_kind", "metric_id"]

#: Delivered rows up to which a run is ranked by one task, with windows; a larger one is ranked by the whole cluster, with the same results.
RUN_ROWS = 500_000


def _by_run(spark: SparkSession, d: str, solve, most: int) -> DataFrame:
    """solve(current hotspots, local) over the runs that fit a task, after one shuffle by run, and over the larger ones if there are any."""
    fits, hot = split_hot(_t(spark, d, "hotspots"), ["run_id"], most)
    now = lambda rows: current_rows(rows, ["run_id", "target_id"], ["target_kind", "rank_score", "components"])
    slim = lambda rows: rows.withColumn("components", F.transform("components", lambda c: F.struct(c["metric_id"].alias("metric_id"), c["value"].alias("value"), c["weight"].alias("weight"))))
    found = solve(now(slim(fits).select("run_id", "target_id", "target_kind", "rank_score", "components", "delivered_at").repartition("run_id")), True)
    return found if hot is None else found.unionByName(solve(now(slim(hot)), False))


def p2_ranking(spark: SparkSession, d: str, most: int = RUN_ROWS) -> DataFrame:
    def solve(now: DataFrame, local: bool) -> DataFrame:
        parts = now.select("run_id", "target_kind", "target_id", F.inline("components"))
        return ranking.borda_ranking(ranking.component_ranks(parts, _GROUP, local=local), ["run_id"], "target_kind", "target_id", "metric_id", local=local)

    return _by_run(spark, d, solve, most)


def p2_found(spark: SparkSession, d: str, most: int = RUN_ROWS) -> DataFrame:
    """Stored scores against those from the component ranks that the Borda count takes its points from (component_ranks)."""

    def solve(now: DataFrame, local: bool) -> DataFrame:
        parts = now.select("run_id", "target_kind", "target_id", "rank_score", F.inline_outer("components"))
        right = ranking.ecdf_scores(ranking.component_ranks(parts, _GROUP, local=local), ["run_id", "target_id"], also=[F.max("rank_score").alias("rank_score")])
        off = F.col("rank_score").isNull() | F.coalesce(F.abs(F.col("rank_score") - F.col("score")) > 0.001, F.lit(False)) | (F.isnan("rank_score") & F.col("score").isNotNull())
        return right.where(off).select("run_id", "target_id")

    return _by_run(spark, d, solve, most)


# 4: percentiles

_SET = ["metric_id", "target_kind", "snapshot_no"]


def _partials(spark: SparkSession, d: str) -> DataFrame:
    metrics = _t(spark, d, "metrics").where(untagged())
    now = current_rows(metrics, ["target_id", "metric_id", "snapshot_no"], ["numeric_value", "target_kind"])
    return percentiles.value_counts(now, _SET, "numeric_value")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_partials(spark, d), _SET, [5, 25, 50, 75, 95, 99])


def p4_overall(spark: SparkSession, d: str) -> DataFrame:
    """The partials of all snapshots merged into one result per metric."""
    merged = percentiles.merge_counts([_partials(spark, d)], ["metric_id"])
    return percentiles.percentiles(merged, ["metric_id"], [50, 95])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    each = percentiles.percentiles(_partials(spark, d), _SET, [50, 95]).select("metric_id", "target_kind", "snapshot_no", F.col("pct").cast("int").alias("pct"), "nearest")
    # a case needs both neighbours: each result counts for its own snapshot and as the one before the next
    sides = F.explode(F.array(F.struct(F.col("snapshot_no").alias("at"), F.lit(1).alias("own")), F.struct((F.col("snapshot_no") + 1).alias("at"), F.lit(0).alias("own"))))
    pair = each.withColumn("s", sides).groupBy("metric_id", "target_kind", F.col("s.at").alias("snapshot_no"), "pct")
    both = pair.agg(F.max(F.when(F.col("s.own") == 0, F.col("nearest"))).alias("a"), F.max(F.when(F.col("s.own") == 1, F.col("nearest"))).alias("b"))
    moved = (F.abs(F.col("b") - F.col("a")) >= 5) & ((F.col("b") >= 2 * F.col("a")) | (F.col("b") <= F.col("a") / 2))
    return both.where(moved).select("metric_id", "target_kind", "snapshot_no", "pct")


# 7: token ids


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(_t(spark, d, "documents"), ["doc_id"])


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens per source as spelled."""
    sized = encode_column(_t(spark, d, "documents"), ["source"], ids=False)
    return sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each text as its ids decode."""
    return decode_column(p7_ids(spark, d), ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


# 8: a mix of sources


def _plan(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = _t(spark, d, "mix_targets")
    sizes = mixing.size_documents(_t(spark, d, "documents"), targets)
    return (sizes, *mixing.plan_mix(sizes, targets, whole))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose fit takes every document as often as it may and still doesn't fill their share of all tokens."""
    full = "reached_tokens = tokens * max_repeats AND reached_tokens < target_share * all_tokens"
    return _plan(spark, d, whole=True)[2].where(full).select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[2]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes, plan, _ = _plan(spark, d)
    return mixing.select_documents(sizes, plan)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the mix: documents that come too often, documents that come from elsewhere or twice, and whether the reached tokens are the budget
    but for less than a document."""
    targets = _t(spark, d, "mix_targets")
    sizes, plan, report = _plan(spark, d)
    mix = mixing.select_documents(sizes, plan)
    caps = targets.select(mixing.source_key(F.col("source")).alias("key"), F.coalesce("max_repeats", F.lit(1)).alias("cap")).groupBy("key").agg(F.max("cap").alias("cap"))
    from_docs = _t(spark, d, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("own"))
    seen = mix.groupBy("doc_id", "key").agg(F.sum("repeats").alias("repeats"), F.count("*").alias("times")).join(from_docs, "doc_id", "left")
    bad = seen.join(F.broadcast(caps), "key", "left").groupBy("key").agg(F.count_if(F.col("repeats") > F.col("cap")).alias("too_often"), F.count_if(~F.col("own").eqNullSafe(F.col("key"))).alias("foreign"), F.count_if(F.col("times") > 1).alias("twice"))
    longest = sizes.groupBy("key").agg(F.max("n_tokens").alias("longest"))
    short_of = F.col("budget") - F.col("reached_tokens")
    near = report.withColumn("key", mixing.source_key(F.col("source"))).join(longest, "key", "left").select("source", "key", ((F.col("docs") == 0) | ((short_of >= 0) & (short_of <= F.col("longest")))).alias("met"))
    return near.join(bad, "key", "left").na.fill(0).select("source", "met", "too_often", "foreign", "twice")


# 9: personal information


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_items(_t(spark, d, "documents")).select("doc_id", "kind", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_documents(_t(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each redacted text with the items put back in place of their placeholders."""
    docs = _t(spark, d, "documents")
    items = pii.find_items(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("items"))
    clean = pii.redact_documents(docs).withColumnRenamed("text", "clean")
    both = docs.select("doc_id", "text").join(clean, "doc_id").join(items, "doc_id", "left")
    mark = lambda kind: F.length(kind) + 2
    # (text so far, where to go on in the redacted text, where in the original)
    step = lambda acc, i: F.struct(
        F.concat(acc["out"], F.substring(F.col("clean"), acc["at"], i["start_pos"] - acc["from"]), F.substring(F.col("text"), i["start_pos"] + 1, i["end_pos"] - i["start_pos"])).alias("out"),
        (acc["at"] + i["start_pos"] - acc["from"] + mark(i["kind"])).cast("bigint").alias("at"), i["end_pos"].alias("from"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("from"))
    none = F.array().cast("array<struct<start_pos:bigint,end_pos:bigint,kind:string>>")
    whole = F.aggregate(F.coalesce("items", none), start, step)
    text = F.concat(whole["out"], F.substring(F.col("clean"), whole["at"], F.lit(1 << 30)))
    return both.select("doc_id", F.md5(text).alias("text_md5"), (F.coalesce(F.size("items"), F.lit(0)) == F.col("n_items")).alias("counted"))


QUERIES = {
    "p9_found": p9_found, "p9_redacted": p9_redacted, "p9_restored": p9_restored,
    "p7_ids": p7_ids, "p7_counts": p7_counts, "p7_decoded": p7_decoded, "p8_found": p8_found, "p8_shares": p8_shares, "p8_mix": p8_mix, "p8_checks": p8_checks,
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_whole": p1_whole, "p2_found": p2_found, "p2_ranking": p2_ranking,
    "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p4_overall": p4_overall,
}

_CURRENT = """
cur AS (SELECT metric_id, target_kind, snapshot_no, v + 0.0::DOUBLE AS v FROM (  -- -0.0 counts as 0.0
  SELECT target_id, metric_id, snapshot_no, any_value(target_kind) AS target_kind, any_value(numeric_value) AS v
  FROM (SELECT *, rank() OVER (PARTITION BY target_id, metric_id, snapshot_no ORDER BY delivered_at DESC) AS r FROM metrics WHERE coalesce(len(tags), 0) = 0)
  WHERE r = 1 GROUP BY 1, 2, 3) WHERE v IS NOT NULL AND isfinite(v))"""

_HOT = """
now AS (SELECT run_id, target_id, any_value(target_kind) AS target_kind, any_value(rank_score) AS rank_score, any_value(components) AS components
  FROM (SELECT *, rank() OVER (PARTITION BY run_id, target_id ORDER BY delivered_at DESC) AS r FROM hotspots) WHERE r = 1 GROUP BY 1, 2),
parts AS (SELECT run_id, target_kind, target_id, c.metric_id AS metric_id, c.value AS value, c.weight AS weight FROM (SELECT *, unnest(components) AS c FROM now)),
pct AS (SELECT *, CASE WHEN value <= 0 THEN 0.0::DOUBLE ELSE cume_dist() OVER (PARTITION BY run_id, target_kind, metric_id ORDER BY value) END AS p FROM parts WHERE value IS NOT NULL),
rgt AS (SELECT run_id, target_id, sum(p * weight) / sum(weight) AS score FROM pct GROUP BY 1, 2)"""

_SIZED = """
WITH sized AS (SELECT *, CASE WHEN text IS NOT NULL THEN ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0::DOUBLE) ELSE token_estimate END AS size,
  rank() OVER (PARTITION BY chunk_id, snapshot_no ORDER BY delivered_at DESC) AS r FROM chunks)"""

SQL = {
    "p1_found": _SIZED + " SELECT DISTINCT chunk_id, snapshot_no FROM sized WHERE r = 1 AND size > 512",
    "p1_whole": _SIZED + """ SELECT DISTINCT chunk_id, snapshot_no, chunk_kind, true AS fits, md5(text) AS text_md5, CASE WHEN text IS NULL THEN token_estimate::BIGINT END AS tokens FROM sized WHERE r = 1 AND size > 512""",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p8_checks": "SELECT source, true AS met, 0::BIGINT AS too_often, 0::BIGINT AS foreign, 0::BIGINT AS twice FROM mix_targets",
    "p9_restored": "SELECT doc_id, md5(text) AS text_md5, true AS counted FROM documents",
    "p2_ranking": f"""WITH {_HOT}, x AS (SELECT run_id, target_kind, target_id, metric_id, value, greatest(coalesce(weight, 0), 0) AS w FROM parts),
v AS (SELECT *, (rank() OVER (PARTITION BY run_id, target_kind, metric_id ORDER BY value) - 1 + (count(*) OVER (PARTITION BY run_id, target_kind, metric_id, value) + 1) / 2.0::DOUBLE - 0.5::DOUBLE)
  / count(*) OVER (PARTITION BY run_id, target_kind, metric_id) AS p FROM x WHERE value IS NOT NULL UNION ALL SELECT *, 0.5::DOUBLE FROM x WHERE value IS NULL),
s AS (SELECT run_id, target_kind, metric_id, avg(w) AS mean FROM v GROUP BY 1, 2, 3),
f AS (SELECT run_id, target_kind, sum(mean) AS f FROM s GROUP BY 1, 2),
i AS (SELECT v.run_id, v.target_kind, v.target_id, sum(w) AS w, sum(w * p) AS wp, sum(mean) AS held FROM v JOIN s ON s.run_id = v.run_id AND s.target_kind = v.target_kind AND s.metric_id = v.metric_id GROUP BY 1, 2, 3),
h AS (SELECT i.*, CASE WHEN f > 0 THEN held / f ELSE 1 END AS share FROM i JOIN f ON f.run_id = i.run_id AND f.target_kind = i.target_kind),
b AS (SELECT run_id, target_kind, target_id, round(CASE WHEN w > 0 THEN wp / w ELSE 0.5::DOUBLE END * share + (1 - share) * 0.5::DOUBLE, 12) AS points FROM h)
SELECT run_id, target_kind, target_id, points, row_number() OVER (PARTITION BY run_id ORDER BY points DESC, target_id, target_kind) AS rank_no FROM b""",
    "p2_found": f"WITH {_HOT} SELECT n.run_id, n.target_id FROM now n LEFT JOIN rgt s ON s.run_id = n.run_id AND s.target_id = n.target_id WHERE n.rank_score IS NULL OR abs(n.rank_score - s.score) > 0.001::DOUBLE",
    "p4_percentiles": f"""WITH {_CURRENT}, l AS (SELECT metric_id, target_kind, snapshot_no, list(v ORDER BY v) AS x FROM cur GROUP BY 1, 2, 3),
e AS (SELECT *, unnest([5, 25, 50, 75, 95, 99]) AS p, len(x) AS n FROM l)
SELECT metric_id, target_kind, snapshot_no, p::DOUBLE AS pct, n, x[(p * n + 99) // 100] AS nearest,
  x[((n - 1) * p) // 100 + 1] + (x[least(((n - 1) * p) // 100 + 2, n)] - x[((n - 1) * p) // 100 + 1]) * ((((n - 1) * p) % 100) / 100.0::DOUBLE) AS interpolated FROM e""",
    "p4_overall": f"""WITH {_CURRENT}, l AS (SELECT metric_id, list(v ORDER BY v) AS x FROM cur GROUP BY 1), e AS (SELECT *, unnest([50, 95]) AS p, len(x) AS n FROM l)
SELECT metric_id, p::DOUBLE AS pct, n, x[(p * n + 99) // 100] AS nearest,
  x[((n - 1) * p) // 100 + 1] + (x[least(((n - 1) * p) // 100 + 2, n)] - x[((n - 1) * p) // 100 + 1]) * ((((n - 1) * p) % 100) / 100.0::DOUBLE) AS interpolated FROM e""",
    "p4_found": f"""WITH {_CURRENT}, l AS (SELECT metric_id, target_kind, snapshot_no, list(v ORDER BY v) AS x FROM cur GROUP BY 1, 2, 3),
e AS (SELECT metric_id, target_kind, snapshot_no, p AS pct, x[(p * len(x) + 99) // 100] AS b FROM (SELECT *, unnest([50, 95]) AS p FROM l))
SELECT n.metric_id, n.target_kind, n.snapshot_no, n.pct FROM e n JOIN e o ON o.metric_id = n.metric_id AND o.target_kind = n.target_kind AND o.pct = n.pct AND o.snapshot_no = n.snapshot_no - 1
WHERE abs(n.b - o.b) >= 5 AND (n.b >= 2 * o.b OR n.b <= o.b / 2)""",
}
