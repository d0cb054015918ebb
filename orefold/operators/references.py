"""References to records that do not exist, kept as keyed state.

The state has one row per (id, period): bit 0 says that the parent table declares the id in that period, and
bit 1 + n that the n-th referring table refers to it there. Bits merge by OR, so a delivery of new
references or of late parents is merged into the state by one aggregation, in any order and any number of times;
a waiting orphan is a row that has reference bits and no parent bit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_SCHEMA = "id string, period int, bits int"


def deliveries(parents: DataFrame | None, references: Mapping[str, Sequence[DataFrame]], tables: Sequence[str]) -> DataFrame:
    """Delivered rows as state rows, combined before any shuffle.

    parents and every DataFrame of references have the columns id and period (others are ignored);
    references maps a table of `tables` to its DataFrames. Null ids and periods refer to nothing and are left out.
    """
    parts = [(df, 1 << (1 + tables.index(name))) for name, dfs in references.items() for df in dfs]
    if parents is not None:
        parts.append((parents, 1))
    united = None
    for df, bit in parts:
        rows = df.select(F.col("id").cast("string").alias("id"), F.col("period").cast("int").alias("period"), F.lit(bit).alias("bits")).where("id IS NOT NULL AND period IS NOT NULL")
        united = rows if united is None else united.unionByName(rows)
    return united.groupBy("id", "period").agg(F.bit_or("bits").alias("bits"))


def advance(state: DataFrame | None, delivered: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The next state: new references wait or find their parent, arriving parents resolve waiting ones.

    deleted (id, period) takes declarations back, which reopens the references to them.
    """
    rows = delivered.select("id", "period", "bits", F.lit(0).alias("gone"))
    if state is not None:
        rows = rows.unionByName(state.select("id", "period", "bits", F.lit(0).alias("gone")))
    if deleted is not None:
        rows = rows.unionByName(deleted.select("id", "period", F.lit(0).alias("bits"), F.lit(1).alias("gone")))
    merged = rows.groupBy("id", "period").agg(F.bit_or("bits").alias("bits"), F.max("gone").alias("gone"))
    keep = F.when(F.col("gone") == 1, F.col("bits").bitwiseAND(F.lit(~1))).otherwise(F.col("bits"))
    return merged.select("id", "period", keep.alias("bits"))


def _fold(entries: Column) -> Column:
    """The keyed state machine over one id's periods in order: each period with references and no parent waits.

    Carried along: whether a parent was seen before, and the orphans that wait; a parent that comes later
    turns those that waited as unknown into early ones. One pass, with at most one entry per period.
    """
    start = F.struct(
        F.lit(False).alias("seen"),
        F.array().cast("array<struct<period:int,bits:int,seen:boolean,resolved:boolean>>").alias("open"),
    )

    def step(acc: Column, e: Column) -> Column:
        parent = e["bits"].bitwiseAND(F.lit(1)) == 1
        refs = F.shiftright(e["bits"], 1)
        arrived = F.transform(acc["open"], lambda o: F.struct(o["period"], o["bits"], o["seen"], F.lit(True).alias("resolved")))
        waiting = F.array(F.struct(e["period"].alias("period"), refs.alias("bits"), acc["seen"].alias("seen"), F.lit(False).alias("resolved")))
        return F.struct(
            (acc["seen"] | parent).alias("seen"),
            F.when(parent, arrived).when(refs > 0, F.concat(acc["open"], waiting)).otherwise(acc["open"]).alias("open"),
        )

    return F.aggregate(entries, start, step)["open"]


def orphans(state: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Open references per table and period: ref_table, period, id and why the parent is missing.

    `gone`: declared in an earlier period only or also later; `early`: declared in a later one; `unknown`: never.
    An id's entries number its periods, so no group grows with the number of references to it.
    """
    entries = state.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("period", "bits"))).alias("entries"))
    waiting = entries.where(F.exists("entries", lambda e: (e["bits"] > 1) & (e["bits"].bitwiseAND(F.lit(1)) == 0)))
    opened = waiting.select("id", F.explode(_fold(F.col("entries"))).alias("o"))
    named = F.filter(
        F.array(*[F.when(F.col("o.bits").bitwiseAND(F.lit(1 << n)) > 0, F.lit(t)) for n, t in enumerate(tables)]),
        lambda t: t.isNotNull(),
    )
    why = F.when(F.col("o.seen"), "gone").when(F.col("o.resolved"), "early").otherwise("unknown")
    return opened.select(F.explode(named).alias("ref_table"), F.col("o.period").alias("period"), "id", why.alias("state"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """The periodic report: open references per table, period and state."""
    return found.groupBy("ref_table", "period", "state").agg(F.count("*").alias("n"))
