import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from orefold.operators import snapshots
from orefold.operators.snapshots import current_rows, snapshot_changes, untagged

T = lambda d: dt.datetime(2031, 1, d)
SCHEMA = "p string, s int, k string, v double, h string, delivered_at timestamp, change string"


@pytest.fixture(params=["sides as columns", "rows by pair"], autouse=True)
def either_way(request, monkeypatch):
    """Short and long histories have the same results."""
    if request.param == "rows by pair":
        monkeypatch.setattr(snapshots, "SLOTS", 0)


def changes(spark, data, listed=(("a", 1), ("a", 2)), **kw):
    listing = spark.createDataFrame(list(listed), "p string, s int")
    kw = kw or {"number": "v"}
    return snapshot_changes(spark.createDataFrame(data, SCHEMA), listing, scope="p", snapshot="s", keys=["k"], **kw)


def row(s, k, v, day=1, h=None, p="a"):
    return (p, s, k, v, h, T(day) if day else None, "clash")


def test_added_removed_changed_and_same(spark, rows):
    data = [row(1, "gone", 1.0), row(2, "new", 1.0), row(1, "same", 2.0), row(2, "same", 2.0), row(1, "moved", 2.0), row(2, "moved", 3.0)]
    assert rows(changes(spark, data)) == [("a", "gone", 2, "removed"), ("a", "moved", 2, "changed"), ("a", "new", 2, "added")]


def test_numbers_compare_with_tolerance_nulls_nans_and_infinities(spark, rows):
    inf, nan = math.inf, math.nan
    pairs = {"null": (None, None), "nan": (nan, nan), "inf": (inf, inf), "near": (1e12, 1e12 + 1), "noise": (0.5, 0.5 + 1e-12), "null_0": (None, 0.0), "nan_0": (nan, 0.0), "inf_": (inf, -inf), "inf_1": (inf, 1.0), "far": (1.0, 1.0 + 1e-8)}
    data = [row(s, k, v[s - 1]) for k, v in pairs.items() for s in (1, 2)]
    assert [r[1] for r in rows(changes(spark, data))] == ["far", "inf_", "inf_1", "nan_0", "null_0"]


def test_latest_delivery_counts_and_null_delivery_is_oldest(spark, rows):
    data = [row(1, "k", 1.0), row(2, "k", 5.0, day=3), row(2, "k", 1.0, day=9), row(2, "k", 7.0, day=0), row(1, "k", 1.0)]
    assert rows(changes(spark, data)) == []


def test_gaps_unlisted_snapshots_and_scopes(spark, rows):
    listed = [("a", 1), ("a", 3), ("a", 3), ("b", 2), ("b", 3), (None, 1)]
    data = [row(1, "k", 1.0), row(2, "k", 2.0), row(3, "k", 1.0), row(3, "only3", 1.0), row(2, "k", 1.0, p="b"), row(1, "z", 1.0, p=None)]
    assert rows(changes(spark, data, listed)) == [("a", "only3", 3, "added"), ("b", "k", 3, "removed")]


def test_hashes_null_keys_and_empty_tables(spark, rows):
    content = [F.lower("h")]
    data = [row(1, "k", None, h="AB"), row(2, "k", None, h="ab"), row(1, None, None, h="x"), row(2, None, None, h="y"), row(1, "n", None), row(2, "n", None), row(1, "m", None, h="a"), row(2, "m", None)]
    assert rows(changes(spark, data, content=content)) == [("a", None, 2, "changed"), ("a", "m", 2, "changed")]
    assert changes(spark, []).collect() == []
    assert changes(spark, data, listed=[]).collect() == []


def test_current_rows_is_one_per_key(spark, rows):
    df = spark.createDataFrame([("k", 1, T(1)), ("k", 2, T(2)), ("k", 2, T(2)), ("k", 9, None), (None, 4, T(1))], "k string, v int, delivered_at timestamp")
    assert rows(current_rows(df, ["k"], ["v"])) == [(None, 4), ("k", 2)]


def test_untagged(spark):
    df = spark.createDataFrame([(None,), ([],), (["a"],)], "tags array<string>")
    assert df.where(untagged()).count() == 2
