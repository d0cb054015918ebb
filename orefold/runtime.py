"""Session helpers: shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows a side may have at most to be hinted as a broadcast (some tens of MB for narrow rows).
BROADCAST_ROWS = 50_000

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "orefold", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the engine is tested under; on a cluster use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cpus or '*'}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one of our own on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="orefold-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut, lost executors cost nothing.

    Folders written here are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove the folder of a frame from materialize that nothing reads any more."""
    _written.remove((df.sparkSession, df._folder))
    _remove(df.sparkSession, df._folder)


def _remove_written() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is then the cluster's to clear
            return


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """(df, True) with a broadcast hint if df has at most `most` rows, else (df, False) without one."""
    if df.limit(most + 1).count() <= most:
        return F.broadcast(df), True
    return df, False


def spread_join(big: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join many rows with a side that has one row per key, whatever the skew of the many.

    The side is broadcast behind a check of its row count. Beyond it both are shuffled, and the adaptive execution splits the partitions of hot keys over
    several tasks, which needs no copies of the side (spark.sql.adaptive.skewJoin). how: inner, left or left_semi.
    """
    return big.join(small_side(side, most)[0], list(on), how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal, and on plainly equal `on`; both come from the left."""
    names = [*keys, *on]
    other = right.withColumnsRenamed({c: f"__right_{c}" for c in names})
    same = [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in keys] + [F.col(c) == F.col(f"__right_{c}") for c in on]
    return left.join(other, same, how).drop(*[f"__right_{c}" for c in names])


def split_hot(rows: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most `most` rows, rows of the others or None if there are none); together they are all rows.

    For operators that have one way for groups that fit a task and another for groups of any size, with the same results. Only the keys
    are read to count them. Hot keys number at most rows / most; they are broadcast behind a check, else joined by a shuffle.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys)
    if hot.limit(1).count() == 0:
        return rows, None
    side, _ = small_side(hot.withColumnsRenamed({k: f"__hot_{k}" for k in keys}))
    same = [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys]
    return rows.join(side, same, "left_anti"), rows.join(side, same, "left_semi")


def sorted_runs(counts: DataFrame, keys: Sequence[str], value: str, tag: str, parts: int | None = None) -> DataFrame:
    """The full distributed sort with per-partition counts that ranks and percentiles share.

    counts has one row per (keys, value) with its number of rows in `cnt`. The rows are range-partitioned
    by (keys, value), so a hot group is split over many tasks, and written once, so that partition
    numbers stay fixed. A group's offset in a partition is the sum of its counts in the partitions
    before; there are at most (groups + partitions) such counts. Returned: keys, value, cnt, `below`
    (rows of the group with a smaller value) and `total` (rows of the group). A null key is a key like any other.
    """
    n = parts or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(n, *keys, value).withColumn("__pid", F.spark_partition_id())
    ordered = materialize(ordered, tag)
    per_part = ordered.groupBy(*keys, "__pid").agg(F.sum("cnt").alias("__n"))
    by_group = Window.partitionBy(*keys)
    before = by_group.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys,
        "__pid",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(by_group).alias("total"),
    )
    inside = Window.partitionBy(*keys, "__pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordered.withColumn("__inside", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return null_safe_join(ranked, offsets, keys, ["__pid"]).select(*keys, value, "cnt", (F.col("__offset") + F.col("__inside")).alias("below"), "total")
