"""Changes between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefold.runtime import BROADCAST_ROWS, spread_join

#: Finite numbers a and b count as equal where |a - b| <= TOLERANCE * max(1, |a|, |b|).
TOLERANCE = 1e-9

#: Listed snapshots of a scope up to which a key's sides are gathered as columns of one aggregate; for longer histories rows are tagged by pair instead.
SLOTS = 12


def _at(delivered: str) -> Column:
    """Delivery time for ordering; null counts as the oldest."""
    return F.coalesce(F.col(delivered).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def untagged(tags: str = "tags") -> Column:
    """True for rows that aren't broken down by tags (null or empty)."""
    return F.coalesce(F.size(tags), F.lit(0)) <= 0


def current_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str], delivered: str = "delivered_at") -> DataFrame:
    """One row per key: the values of the row delivered last (a null delivery counts as the oldest).

    One shuffle with map-side combining, so a key with very many repeats costs one row per map task.
    Rows that tie in `delivered` are taken to say the same; of unequal ones the larger values win, as a whole.
    """
    last = F.max(F.struct(_at(delivered).alias("at"), *[F.col(v) for v in values])).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values])


def snapshot_pairs(listing: DataFrame, scope: str, snapshot: str) -> DataFrame:
    """Each listed (scope, snapshot) with the snapshots it is the later and the earlier side of.

    listing may repeat rows; the distinct ones number scopes times snapshots. Nulls are left out.
    Columns: scope, snapshot, `sides`: array of (pair, side), where pair is the later snapshot's number,
    and side is 1 for the later and 0 for the earlier snapshot.
    """
    order = Window.partitionBy(scope).orderBy(snapshot)
    listed = listing.select(scope, snapshot).where(F.col(scope).isNotNull() & F.col(snapshot).isNotNull()).distinct()
    near = listed.select(scope, snapshot, F.lag(snapshot).over(order).alias("__before"), F.lead(snapshot).over(order).alias("__next"))
    side = lambda pair, n, there: F.when(there, F.struct(pair.alias("pair"), F.lit(n).alias("side")))
    return near.select(
        scope,
        snapshot,
        F.array_compact(F.array(side(F.col(snapshot), 1, F.col("__before").isNotNull()), side(F.col("__next"), 0, F.col("__next").isNotNull()))).alias("sides"),
    )


def listed_snapshots(listing: DataFrame, scope: str, snapshot: str) -> DataFrame:
    """Each listed (scope, snapshot) with its place __i among the scope's snapshots, from 1, and their number __n."""
    of_scope = Window.partitionBy(scope)
    listed = listing.select(scope, snapshot).where(F.col(scope).isNotNull() & F.col(snapshot).isNotNull()).distinct()
    return listed.withColumns({"__i": F.row_number().over(of_scope.orderBy(snapshot)), "__n": F.count("*").over(of_scope)})


def snapshot_changes(
    rows: DataFrame,
    listing: DataFrame,
    *,
    scope: str,
    snapshot: str,
    keys: Sequence[str],
    content: Sequence[Column] = (),
    number: str | None = None,
    delivered: str = "delivered_at",
) -> DataFrame:
    """Records added, removed or changed between consecutive listed snapshots of each scope.

    Both sides of every pair of snapshots are united, tagged by side, and grouped by key; a single
    aggregation shuffle finds the row delivered last on each side and compares the sides' row hashes
    (64 bits over `content`, compared for equal keys only). Where scopes list at most SLOTS snapshots, a row isn't doubled for the two pairs it belongs to: its side is a column of the
    aggregate. With `number` the number is the content, its 64 bits are the hash, and sides whose
    finite numbers agree within TOLERANCE are unchanged; two nulls or two NaNs are the same. Rows whose scope or snapshot isn't listed, or null, belong to no pair. A null key is a key like
    any other; of unequal rows that tie in `delivered` one counts. Returned: scope, keys, snapshot (the later one) and change; extra columns of rows
    are ignored, an empty table gives no rows.
    """
    value = F.col(number).cast("double") if number else F.xxhash64(*content)
    narrow = rows.select(F.col(scope), F.col(snapshot), *keys, _at(delivered).alias("__at"), value.alias("__v"))
    listed = listed_snapshots(listing, scope, snapshot)
    size = listed.agg(F.max("__i").alias("most"), F.count("*").alias("n")).first()
    most = size.most or 0
    if most > SLOTS:
        return _by_pair(narrow, listing, scope, snapshot, keys, number is not None)
    side = F.broadcast if size.n <= BROADCAST_ROWS else lambda df: df  # checked by the count above
    placed = narrow.join(side(listed), [scope, snapshot])
    at = lambda i: F.when(F.col("__i") == i, F.col("__at"))
    slots = [a for i in range(1, most + 1) for a in (F.max(at(i)).alias(f"__at_{i}"), F.max_by("__v", at(i)).alias(f"__v_{i}"))]
    sides = placed.groupBy(scope, *keys).agg(F.max("__n").alias("__n"), *slots)
    pair = lambda i: F.struct(F.lit(i).alias("__i"), _change(F.col(f"__at_{i - 1}").isNotNull(), F.col(f"__at_{i}").isNotNull(), F.col(f"__v_{i - 1}"), F.col(f"__v_{i}"), number is not None).alias("change"))
    pairs = [F.when(F.col("__n") >= i, pair(i)) for i in range(2, most + 1)] or [F.lit(None).cast("struct<__i:int,change:string>")]
    found = sides.select(scope, *keys, F.explode(F.array(*pairs)).alias("__p")).where("__p.change IS NOT NULL").select(scope, *keys, "__p.__i", "__p.change")
    return found.join(side(listed.select(scope, "__i", snapshot)), [scope, "__i"]).select(scope, *keys, snapshot, "change")


def _change(old: Column, new: Column, a: Column, b: Column, number: bool) -> Column:
    """What happened to a record that is there (old, new) with contents a and b; null if nothing did."""
    same = a.eqNullSafe(b)
    if number:
        finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
        near = F.abs(a - b) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
        same = same | F.coalesce(finite & near, F.lit(False))
    return F.when(~old & new, "added").when(old & ~new, "removed").when(old & new & ~same, "changed")


def _by_pair(narrow: DataFrame, listing: DataFrame, scope: str, snapshot: str, keys: Sequence[str], number: bool) -> DataFrame:
    """The same for histories of any length: each row is tagged once as the later and once as the earlier side of its pairs."""
    tagged = (
        spread_join(narrow, snapshot_pairs(listing, scope, snapshot), [scope, snapshot])
        .withColumn("__s", F.explode("sides"))
        .select(scope, *keys, "__at", "__v", F.col("__s.pair").alias("__pair"), F.col("__s.side").alias("__side"))
    )
    last = lambda n: F.max_by("__v", F.when(F.col("__side") == n, F.col("__at")))
    sides = tagged.groupBy(scope, *keys, "__pair").agg(F.max("__side").alias("__new"), F.min("__side").alias("__old"), last(0).alias("__v_0"), last(1).alias("__v_1"))
    change = _change(F.col("__old") == 0, F.col("__new") == 1, F.col("__v_0"), F.col("__v_1"), number)
    return sides.select(scope, *keys, F.col("__pair").alias(snapshot), change.alias("change")).where("change IS NOT NULL")
