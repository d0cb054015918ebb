import json

from orefold.operators.drift import load_leaves, parse_line, project_typed, schema_changes, spellings
from orefold.queries import training

KEYS = ("targetId", "metricId")


def lines(spark, files):
    data = [(f, s, n, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for (f, s), payloads in files.items() for n, p in enumerate(payloads)]
    return spark.createDataFrame(data, "feed string, file_seq int, line_no int, payload string, leaves string")


def changes(spark, files):
    return schema_changes(lines(spark, files), KEYS)


def rec(t, **kw):
    return {"targetId": t, "metricId": "m", **kw}


def test_every_change(spark, rows):
    files = {
        ("f", 1): [rec("a", old=1, unit="x", v=5, nest={"x": 1}), rec("b", old=2, unit="x", v=6, gone=True)],
        ("f", 3): [rec("a", new=1, unit="y", v="5", nest={"y": {"z": 1}}), rec("b", new=2, unit="y", v=6), "{broken", None, "[1]", '"text"', '{"v": NaN}'],
        ("f", 4): [rec("a", new=1, unit="y", v="5", nest={"y": {"z": 1}}, tags=["t"]), rec("b", new=2, unit="y", v=6)],
        ("g", 1): [rec("a", q=1)],
    }
    assert rows(changes(spark, files)) == [
        ("f", 3, "removed", "gone", ""),
        ("f", 3, "renamed", "nest.x", "nest.y.z"),
        ("f", 3, "renamed", "old", "new"),
        ("f", 3, "retyped", "v", "v"),
        ("f", 4, "added", "", "tags"),
    ]


def test_half_of_the_values_is_no_rename_and_nulls_are_absent(spark, rows):
    files = {("f", 1): [rec("a", x=1), rec("b", x=2), rec("c", x=None, w=None)], ("f", 2): [rec("a", y=1), rec("b", y=3), rec("d", y=9)]}
    assert rows(changes(spark, files)) == [("f", 2, "added", "", "y"), ("f", 2, "removed", "x", "")]


def test_one_rename_per_field_the_best_share_first(spark, rows):
    files = {("f", 1): [rec(t, x=1) for t in "abc"], ("f", 2): [rec("a", y=1, z=1), rec("b", y=1, z=1), rec("c", y=2, z=1)]}
    assert rows(changes(spark, files)) == [("f", 2, "added", "", "y"), ("f", 2, "renamed", "x", "z")]


def test_repeated_files_and_records(spark, rows):
    one = [rec("a", x=1), rec("a", x=1), rec("a", x=2)]
    assert rows(changes(spark, {("f", 1): one * 2, ("f", 2): [rec("a", y=2)]})) == [("f", 2, "renamed", "x", "y")]
    assert changes(spark, {("f", 1): ["{"], ("f", 2): ["{"]}).collect() == []


def test_lines_without_keys_are_no_records_unless_they_are_the_file(spark, rows):
    files = {("f", 1): [{"x": 1}] * 3, ("f", 2): [{"y": 1}] * 3}
    assert rows(changes(spark, files)) == [("f", 2, "added", "", "y"), ("f", 2, "removed", "x", "")]
    whole = lines(spark, files).selectExpr("*", "true AS whole")
    assert rows(schema_changes(whole, KEYS, whole="whole")) == [("f", 2, "renamed", "x", "y")]


def test_files_without_a_line_that_parses_have_no_fields(spark, rows):
    files = {("f", 1): [rec("a", x=1)], ("f", 2): ["{", None], ("f", 3): [rec("a", x=1)]}
    every = [c for p in (2, 3) for c in [(p, "removed" if p == 2 else "added", f) for f in ("metricId", "targetId", "x")]]
    assert rows(changes(spark, files)) == [("f", p, c, f if c == "removed" else "", f if c == "added" else "") for p, c, f in every]


def test_parse_line():
    assert parse_line("{}", KEYS) == (True, None, {})
    ok, key, leaves = parse_line('{"targetId":"t","a":{"b":[1,{"c":null}],"n":null,"f":true,"d":1e400}}', KEYS)
    assert ok and json.loads(key) == ["t", None]
    assert leaves == {"targetId": ("string", "t"), "a.b": ("array", '[1, {"c": null}]'), "a.f": ("boolean", "true"), "a.d": ("number", "inf")}
    assert parse_line("[" * 100000, KEYS)[0] is False


def test_typed_projection_reports_failed_casts(spark):
    df = load_leaves(lines(spark, {("f", 1): [rec("a", startLine="12", numericValue="x", extra={"p": 1}), rec("b", line_start=7, numericValue=2.5, tags=["q"]), "{"]}), KEYS)
    cols = {"targetId": "string", "numericValue": "double", "startLine": "int", "tags": "array<string>"}
    out = sorted(project_typed(df, cols, {"startLine": ["line_start"]}, ["feed"]).collect())
    assert [(r.targetId, r.numericValue, r.startLine, r.tags, r.failed_casts) for r in out] == [("a", None, 12, None, ["numericValue"]), ("b", 2.5, 7, ["q"], [])]
    assert out[0].extra == {"metricId": "m", "extra.p": "1"}


def test_spellings_never_join_two_columns():
    assert spellings(["a", "b"], [("a", "x", 3), ("x", "b", 2), ("x", "y", 1), ("p", "q", 9)]) == {"a": ["x", "y"]}
    assert spellings(["a", "b"], [("x", "b", 1)], [("a", "x", 9), ("a", "z", 1)]) == {"b": ["x"], "a": ["z"]}  # a feed's own renames go first


def test_table_of_both_artifacts_with_spellings_of_these_files(spark, tmp_path):
    metric, manifest = "metrics.ndjson", "manifest.json"
    files = {
        ("f", metric, 1): [rec(t, numericValue=v, unit="u") for t, v in (("a", 1.5), ("b", 2.5))],
        ("f", metric, 2): [rec(t, amount=v, unit="u") for t, v in (("a", 1.5), ("b", 2.5))],
        ("g", metric, 1): [rec("c", amount="3.5", unit="u", path="p")],  # only the other feed tells this spelling
        ("m", manifest, 1): [{"rootPath": "/r", "input": {"kind": "solution"}, "durationMs": "x", "amount": 4}],
        ("m", manifest, 2): [{"base": {"dir": "/r"}, "inputType": "solution", "durationMs": 7, "amount": 4}],
    }
    data = [(f, a, s, n, json.dumps(p)) for (f, a, s), payloads in files.items() for n, p in enumerate(payloads)]
    spark.createDataFrame(data, "feed string, artifact string, file_seq int, line_no int, payload string").write.parquet(str(tmp_path / "artifact_lines.parquet"))
    out = sorted(training.p5_table(spark, str(tmp_path)).collect(), key=lambda r: (r.feed, r.file_seq, r.line_no))
    assert [(r.feed, r.file_seq, r.numericValue) for r in out if r.artifact == metric] == [("f", 1, 1.5), ("f", 1, 2.5), ("f", 2, 1.5), ("f", 2, 2.5), ("g", 1, 3.5)]
    assert [(r.file_seq, r.rootPath, r.input_kind, r.durationMs, r.extra) for r in out if r.artifact == manifest] == [(1, "/r", "solution", None, '{"amount":"4"}'), (2, "/r", "solution", 7, '{"amount":"4"}')]
    assert json.loads(out[4].extra) == {"path": "p"}
    assert [tuple(r) for r in training.p5_casts(spark, str(tmp_path)).collect()] == [("m", 1, "durationMs", 1)]
