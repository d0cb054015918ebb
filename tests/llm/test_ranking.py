import random

import pytest
from pyspark.sql import functions as F

from orefold.llm.ranking import borda_ranking, component_ranks, ecdf_scores

SCHEMA = "run string, kind string, item string, metric string, value double, weight double, below string"


def brute(data):
    """Points by hand: average ranks as shares, missing values at the middle, missing rows with the kind's mean weight."""
    out = {}
    for run, kind, item in {(d[0], d[1], d[2]) for d in data}:
        own = [d for d in data if d[:3] == (run, kind, item)]
        group = [d for d in data if d[:2] == (run, kind)]
        means = {}
        for m in {d[3] for d in group}:
            ws = [max(0.0, d[5] or 0.0) for d in group if d[3] == m]
            means[m] = sum(ws) / len(ws)
        total = up = 0.0
        for _, _, _, m, v, w in own:
            w = max(0.0, w or 0.0)
            vs = [d[4] for d in group if d[3] == m and d[4] is not None]
            p = 0.5 if v is None else (sum(x < v for x in vs) + (sum(x == v for x in vs) + 1) / 2 - 0.5) / len(vs)
            total, up = total + w, up + w * p
        full = sum(means.values())
        share = sum(means[d[3]] for d in own) / full if full else 1.0
        out[run, kind, item] = round((up / total if total else 0.5) * share + (1 - share) * 0.5, 9)
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    data = [(f"r{r}", rng.choice("ab"), f"i{r}{i}", m, rng.choice([None, 0.0, -1.0, 5.0, float(rng.randint(0, 9)) * 10**k]), rng.choice([0.3, 30.0, 1.0])) for r in range(3) for i in range(25) for k, m in enumerate(("x", "y", "z")) if rng.random() < 0.9]
    data = [(d[0], "a" if int(d[2][2:]) % 2 else "b", *d[2:]) for d in data]
    ranked = component_ranks(spark.createDataFrame([(*d, None) for d in data], SCHEMA), ["run", "kind", "metric"])
    want = brute(data)
    out = borda_ranking(ranked, ["run"], "kind", "item", "metric").collect()
    assert {(r.run, r.kind, r.item): round(r.points, 9) for r in out} == pytest.approx(want)
    for run in {d[0] for d in data}:
        mine = sorted((r for r in out if r.run == run), key=lambda r: r.rank_no)
        assert [r.rank_no for r in mine] == list(range(1, len(mine) + 1))
        assert [r.item for r in mine] == [r.item for r in sorted(mine, key=lambda r: (-r.points, r.item))]


def test_range_rules_nothing_and_ecdf(spark):
    data = [("r", "k", "a", "small", 0.9, 1.0), ("r", "k", "b", "small", 0.1, 1.0), ("r", "k", "a", "huge", 1e12, 1.0), ("r", "k", "b", "huge", 2e12, 1.0), ("r", "k", "c", "small", None, 1.0), ("r", "k", "d", "small", -1.0, 1.0)]
    df = spark.createDataFrame([(*d, None) for d in data], SCHEMA)
    ranked = component_ranks(df, ["run", "kind", "metric"])
    points = {r.item: r.points for r in borda_ranking(ranked, ["run"], "kind", "item", "metric").collect()}
    near = df.withColumn("value", F.when(F.col("metric") == "huge", F.col("value") / 1e12).otherwise(F.col("value")))
    same = {r.item: r.points for r in borda_ranking(component_ranks(near, ["run", "kind", "metric"]), ["run"], "kind", "item", "metric").collect()}
    assert points == same and points["c"] == 0.5
    scores = {r.item: r.score for r in ecdf_scores(ranked, ["run", "item"]).collect()}
    assert scores == {"a": pytest.approx(0.75), "b": pytest.approx((2 / 3 + 1) / 2), "c": None, "d": 0.0}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert borda_ranking(component_ranks(df, ["run", "kind", "metric"]), ["run"], "kind", "item", "metric").collect() == []
