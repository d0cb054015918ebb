import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from orefold.catalog import METRICS, catalog_frame, find
from orefold.functions import scalar as fn
from orefold.operators import duplication, graph, intervals
from orefold.operators import relational as rel


def test_catalog():
    assert len(METRICS) == 66
    assert find("hotspot_rank").version == "2.0.0"
    assert find("lines_of_code@1.0.0").target_kinds == ("solution", "project", "file", "type")
    assert find("lines_of_code@2.0.0") is None and find("nothing") is None


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("src/**/*.cs", "src/A.cs", True), ("src/**/*.cs", "src/Nested/A.cs", True), ("*.cs", "A.cs", True), ("*.cs", "src/A.cs", False), ("./src/*.cs", "src/A.cs", True),
        ("src/?ample.cs", "src/Sample.cs", True), ("src/*.cs", "src/Nested/A.cs", False), ("**/Generated/*.cs", "Generated/A.cs", True), ("**/Generated/*.cs", "src/Generated/A.cs", True),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert spark.range(1).select(fn.glob_filter(F.lit(path), [pattern], [])).first()[0] is hit


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fn.project_key(F.lit("src/App.csproj"))) == "44386ef356d2e41b"
    assert one(fn.token_estimate(F.lit("a😀bc"))) == 2 and one(fn.token_estimate(F.lit(""))) == 0
    assert one(fn.line_range(F.lit("a\r\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert one(fn.short_number(F.lit(0.25))) == "0.25" and one(fn.short_number(F.lit(1.0))) == "1" and one(fn.short_number(F.lit(23.0), 6)) == "23"
    assert [one(fn.is_generated(F.lit(p))) for p in ("a/B.g.cs", "a/AssemblyInfo.cs", "a/B.cs", "x/b.Designer.cs")] == [True, True, False, True]
    assert [fn.is_mathematical_integer(x) for x in ("1", "1.0", "1e400", "1.5", "15e-1", "0.0", "-2e0", "x")] == [True, True, True, False, False, True, True, False]
    assert one(F.round(F.lit(0.0078125), 6)) == 0.007813


def test_ecdf_nearest_rank_and_global_rank(spark, rows):
    rng = random.Random(1)
    data = [("g" if rng.random() < 0.8 else "h", i, rng.choice([None, -1.0, 0.0, float(rng.randint(1, 9))])) for i in range(200)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    for r in rel.ecdf(df, ["g"], "v").collect():
        vs = [v for g, _, v in data if g == r.g and v is not None]
        want = None if r.v is None else 0.0 if r.v <= 0 else sum(v <= r.v for v in vs) / len(vs)
        assert r.percentile == (None if want is None else pytest.approx(want))
    for r in rel.nearest_rank(df, ["g"], "v", 95).collect():
        vs = sorted(v for g, _, v in data if g == r.g and v is not None)
        assert (r.nearest, r.n) == (vs[math.ceil(0.95 * len(vs)) - 1], len(vs))
    ranked = rel.global_rank(df.where("v IS NOT NULL"), [-F.col("v"), F.col("i")])
    assert [r.i for r in ranked.sort("rank_no").collect()] == [i for _, i, v in sorted((x for x in data if x[2] is not None), key=lambda x: (-x[2], x[1]))]
    assert rel.ecdf(df.limit(0), ["g"], "v").collect() == []


def test_rollup_counts_shared_items_once_in_all(spark, rows):
    items = spark.createDataFrame([("a", 1), ("b", 2)], "i string, n int")
    member = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "q"), ("a", "p")], "i string, s string")
    assert rows(rel.scope_rollup(items, member, "i", "s", ["n"])) == [("all", "all", 3), ("item", "a", 1), ("item", "b", 2), ("scope", "p", 1), ("scope", "q", 3)]


def test_ratios_tags_prefixes_and_debt(spark, rows):
    df = spark.createDataFrame([(1, 1, 2), (2, 1, 0), (3, None, 2), (4, 1, None)], "k int, a int, b int")
    assert rows(rel.ratios(df, ["k"], {"r": ("a", "b")})) == [(1, "r", 0.5)]
    tags = spark.createDataFrame([("x", ["a", "a", "b"]), ("x", None), ("y", [])], "k string, t array<string>")
    assert rows(rel.tag_slices(tags, ["k"], "t")) == [("x", None, 2), ("x", "a", 1), ("x", "b", 1), ("y", None, 1)]
    assert rows(rel.merged_tags(tags, ["k"], "t")) == [("x", ["a", "b"]), ("y", None)]
    paths = spark.createDataFrame([("a/b/c.cs",), ("a/x.cs",), ("ab/c.cs",), (None,)], "path string")
    dirs = spark.createDataFrame([("a",), ("a/b",), ("a",)], "dir string")
    assert rows(rel.longest_prefix(paths, "path", dirs, "dir")) == [(None, None), ("a/b/c.cs", "a/b"), ("a/x.cs", "a"), ("ab/c.cs", None)]
    values = spark.createDataFrame([("a", "cc", 15.0), ("a", "len", 55.0), ("b", "cc", 8.0), ("b", "len", 40.0)], "target_id string, metric_id string, value double")
    limits = spark.createDataFrame([("cc", 10.0, 1.0), ("len", 45.0, 1.0)], "metric_id string, maximum double, weight double")
    assert tuple(rel.threshold_debt(values, limits).first()) == (15.0, 225.0, 1, 15.0)


def test_value_violations(spark, rows):
    df = spark.createDataFrame([("nope", "file", 1.0), ("lines_of_code", "member", 1.0), ("lines_of_code", "file", None), ("lines_of_code", "file", math.nan), ("lines_of_code", "file", 1.5), ("token_line_ratio", "file", 0.5)], "metric_id string, target_kind string, numeric_value double")
    assert sorted(r.problem for r in rel.value_violations(df).collect()) == ["fractional integer", "no number", "not finite", "unknown metric", "unsupported target kind"]
    assert catalog_frame(spark).count() == 66


def test_overlaps_against_brute_force(spark):
    rng = random.Random(2)
    spans = [(f"t{rng.randint(0, 9)}", rng.choice("fg"), a := rng.randint(1, 400), a + rng.randint(0, 200)) for _ in range(40)]
    marks = [(i, rng.choice("fg"), a := rng.randint(1, 400), a + rng.randint(0, 90)) for i in range(60)] + [(99, "f", None, None), (98, "f", 5, 2_000_000_000), (97, "g", 300, 100)]
    spans += [("t1", "g", 1, 2_000_000_000), ("t9", "f", 7, 3)]
    out = intervals.overlap_counts(spark.createDataFrame(spans, "t string, f string, start int, end int"), ["t"], spark.createDataFrame(marks, "m int, f string, start int, end int"), "m", ["f"])
    for r in out.collect():
        want = {m for m, f, a, b in marks if a is not None and a <= b and any(t == r.t and g == f and s <= e and a <= e and b >= s for t, g, s, e in spans)}
        assert r.n == len(want)


def test_islands(spark, rows):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 9, 12), ("a", 10, 11), ("b", 1, 1)], "k string, start int, end int")
    assert rows(intervals.merged_islands(df, ["k"], True)) == [("a", 1, 5), ("a", 9, 12), ("b", 1, 1)]
    assert rows(intervals.merged_islands(df, ["k"], False)) == [("a", 1, 3), ("a", 4, 5), ("a", 9, 12), ("b", 1, 1)]
    assert rows(intervals.covered(df, ["k"])) == [("a", 9), ("b", 1)]


def brute_windows(texts, size, lines):
    win = {}
    for f, text in texts.items():
        words, first, last = duplication.word_tokens(text)
        for p in range(len(words) - size + 1):
            if last[p + size - 1] - first[p] + 1 >= lines:
                win.setdefault(tuple(words[p : p + size]), []).append((f, p))
    out = set()
    for places in win.values():
        files = {f for f, _ in places}
        for f, p in places:
            if len(files) > 1 or p - min(x for _, x in places) >= size or max(x for _, x in places) - p >= size:
                out.add((f, p))
    return out


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(2))
    texts = {f"f{i}": "".join(word() + rng.choice(" \n") for _ in range(rng.randint(0, 80))) for i in range(12)} | {"empty": "", "null": None}
    df = spark.createDataFrame(list(texts.items()), "f string, t string")
    windows = duplication.token_windows(df, "f", "t", duplication.word_tokens, 7, 2)
    got = {(r.file, r.pos) for r in duplication.repeated_windows(windows, 7).collect()}
    assert got == brute_windows({k: v or "" for k, v in texts.items()}, 7, 2) and got
    regions = duplication.with_tags(duplication.duplicated_regions(duplication.repeated_windows(windows, 7), 7)).sort("file", "start").collect()
    assert [r.tag for r in regions] == [f"duplication_block:{i:06d}" for i in range(1, len(regions) + 1)]
    assert {(r.file, p) for r in regions for p in range(r.start, r.end)} == {(f, q) for f, p in got for q in range(p, p + 7)}


def closure(n, edges):
    reach = {(a, b) for a, b in edges}
    for k in range(n):
        reach |= {(a, b) for a in range(n) for b in range(n) if (a, k) in reach and (k, b) in reach}
    return reach


def check_graph(n, edges):
    reach = closure(n, edges)
    for v, _, size, out, back in graph.analyse(list(range(n)), edges):
        group = {w for w in range(n) if (v, w) in reach and (w, v) in reach}
        assert size == len(group)
        assert out == len({w for w in range(n) if (v, w) in reach} - {v}) and back == len({w for w in range(n) if (w, v) in reach} - {v})


def test_all_graphs_of_three_nodes():
    pairs = list(itertools.product(range(3), repeat=2))
    for mask in range(512):
        check_graph(3, [p for i, p in enumerate(pairs) if mask >> i & 1])


def test_random_graphs_and_a_deep_chain():
    rng = random.Random(20261107)
    for _ in range(100):
        n = rng.randint(1, 16)
        check_graph(n, [(a, b) for a in range(n) for b in range(n) if rng.random() < 0.15])
    deep = {r[0]: r for r in graph.analyse(range(12000), [(i, i + 1) for i in range(11999)])}
    assert deep[0][3] == 11999 and deep[11999][4] == 11999


def test_graph_measures_and_the_distributed_way_agree(spark, monkeypatch):
    edges = [("g", a, b) for a, b in ("ab", "ba", "ac", "bd", "ce", "de", "ee")] + [("h", "x", "y"), ("h", None, "y")]
    e = spark.createDataFrame(edges, "k string, from_id string, to_id string")
    nodes = spark.createDataFrame([("g", "f"), ("g", "a"), ("h", "z")], "k string, node string")
    one = {(r.k, r.node): r for r in graph.graph_measures(e, nodes, ["k"]).collect()}
    assert (one["g", "a"].cyclic_size, one["g", "a"].reachable, one["g", "e"].dependents, one["g", "c"].dependents, one["g", "e"].cyclic_size) == (2, 4, 4, 2, 1)
    assert tuple(one["g", "f"])[2:] == ("f", 0, 0, 0) and one["h", "y"].dependents == 1 and len(one) == 9
    monkeypatch.setattr(graph, "TASK_EDGES", 3)
    two = {(r.k, r.node): r for r in graph.graph_measures(e, nodes, ["k"]).collect()}
    assert {k: (r.component, r.cyclic_size) for k, r in one.items()} == {k: (r.component, r.cyclic_size) for k, r in two.items()}
