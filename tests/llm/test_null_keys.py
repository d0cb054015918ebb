"""Groups whose key is null are groups like any other."""

from orefold.llm.percentiles import percentiles, value_counts
from orefold.llm.ranking import borda_ranking, component_ranks


def test_percentiles_of_null_keys(spark, rows):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "a", 3.0), ("m", None, 5.0), (None, None, 7.0), ("m", "a", 9.0)], "m string, k string, v double")
    found = percentiles(value_counts(df, ["m", "k"], "v"), ["m", "k"], [50, 100]).select("m", "k", "pct", "n", "nearest")
    assert rows(found) == [
        (None, None, 50.0, 1, 7.0), (None, None, 100.0, 1, 7.0), (None, "a", 50.0, 2, 1.0), (None, "a", 100.0, 2, 3.0),
        ("m", None, 50.0, 1, 5.0), ("m", None, 100.0, 1, 5.0), ("m", "a", 50.0, 1, 9.0), ("m", "a", 100.0, 1, 9.0),
    ]


def test_ranking_of_null_keys(spark, rows):
    df = spark.createDataFrame([(None, "t", "a", "s", 1.0, 1.0), (None, "t", "b", "s", 2.0, 1.0), (1, None, "c", "s", 3.0, 1.0), (1, None, "d", "s", None, 1.0)], "run int, kind string, item string, score string, value double, weight double")
    ranked = component_ranks(df, ["run", "kind", "score"])
    assert rows(ranked.select("item", "below", "ties", "total")) == [("a", 0, 1, 2), ("b", 1, 1, 2), ("c", 0, 1, 1), ("d", None, None, None)]
    assert rows(borda_ranking(ranked, ["run"], "kind", "item", "score").select("run", "kind", "item", "rank_no")) == [(None, "t", "a", 2), (None, "t", "b", 1), (1, None, "c", 1), (1, None, "d", 2)]
