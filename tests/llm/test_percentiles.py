import math
import random

import numpy as np
import pytest

from orefold.llm.percentiles import merge_counts, percentiles, value_counts

SCHEMA = "g string, day int, v double, cnt string"


def frame(spark, data):
    return spark.createDataFrame([(*d, "clash") for d in data], SCHEMA)


def test_against_numpy_and_merging(spark):
    rng = random.Random(6)
    special = [None, math.nan, math.inf, -math.inf, 0.0, -0.0]
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 3)}", rng.randint(1, 3), rng.choice([*special, float(rng.randint(-5, 5)), rng.gauss(0, 1e6)])) for _ in range(3000)] + [("one", 1, 7.0), ("none", 1, None)]
    days = [value_counts(frame(spark, [d for d in data if d[1] == day]), ["g", "day"], "v") for day in (1, 2, 3)]
    merged = merge_counts(days, ["g"])
    out = percentiles(merged, ["g"], [0, 5, 50, 95, 99.9, 100]).collect()
    assert len(out) == 6 * 6
    for r in out:
        x = np.sort([v for g, _, v in data if g == r.g and v is not None and math.isfinite(v)])
        assert r.n == len(x) and r.nearest == x[max(1, math.ceil(round(r.pct * 100) * len(x) / 10000)) - 1]
        assert r.interpolated == pytest.approx(np.percentile(x, r.pct))


def test_grain_bounds_the_error(spark):
    rng = random.Random(9)
    xs = [rng.lognormvariate(0, 5) * rng.choice([1, -1]) for _ in range(2000)] + [0.0] * 50
    fine = percentiles(value_counts(frame(spark, [("g", 1, x) for x in xs]), ["g"], "v"), ["g"], [5, 50, 90]).sort("pct").collect()
    parts = value_counts(frame(spark, [("g", 1, x) for x in xs]), ["g"], "v", grain=0.01)
    rough = percentiles(parts, ["g"], [5, 50, 90]).sort("pct").collect()
    assert parts.count() < 1900
    for a, b in zip(fine, rough):
        assert b.nearest == pytest.approx(a.nearest, rel=0.0101)


def test_empty(spark):
    assert percentiles(value_counts(frame(spark, []), ["g"], "v"), ["g"], [50]).collect() == []
