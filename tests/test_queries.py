"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(spark, name, queries, sql):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries[name](spark, str(DATA))
    cols = sorted(df.columns)
    cur = con.execute(sql[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


CORE = ("p3_found", "p5_found", "p6_found", "scope_rollup", "catalog_check", "fan_out_lifted", "interval_overlap_count", "hotspot_topk", "duplicate_regions", "reach_counts", "scc_size", "longest_prefix", "threshold_debt", "target_mismatches")


@pytest.mark.parametrize("name", CORE)
def test_core_query(spark, name):
    compare(spark, name, entry.queries(), entry.oracle_sql())


def test_every_query_has_a_name_of_its_own_and_sql_belongs_to_one():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert sum(len(m.QUERIES) for m in entry._all_modules()) == len(queries)
    assert entry.entry is not None
