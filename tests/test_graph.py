"""Reachability of graphs that are too large for one task."""

from orefold.operators import graph


def test_large_graphs_have_exact_counts(spark, monkeypatch):
    hub = [("g", "h", f"x{i:02}") for i in range(70)] + [("g", "x00", "h"), ("g", "x01", "z"), ("g", "z", "z"), ("g", "y", "x69")]  # 72 components in two words
    two = [("k", a, b) for a, b in ("ab", "ba", "bc", "cd", "dc", "ed")]
    e = spark.createDataFrame([*hub, *two, ("small", "p", "q")], "k string, from_id string, to_id string")
    nodes = spark.createDataFrame([("g", "alone"), ("k", "a")], "k string, node string")
    want = sorted(tuple(r) for r in graph.graph_measures(e, nodes, ["k"]).collect())
    monkeypatch.setattr(graph, "TASK_EDGES", 3)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 1)  # one word at a time
    assert sorted(tuple(r) for r in graph.graph_measures(e, nodes, ["k"]).collect()) == want
    at = {(r[0], r[1]): r[2:] for r in want}
    assert at["g", "h"] == ("h", 2, 71, 1) and at["g", "alone"] == ("alone", 0, 0, 0) and at["k", "a"] == ("a", 2, 3, 1) and at["k", "d"] == ("c", 2, 1, 4)
