import itertools
import random

from orefold.operators.references import advance, deliveries, orphan_counts, orphans
from orefold.streaming.orphans import OrphanStream

TABLES = ("edges", "metrics")


def df(spark, data):
    return spark.createDataFrame(data, "id string, period int")


def brute(parents, refs):
    out = set()
    for table, ids in refs.items():
        for i, p in ids:
            if i is None or p is None or (i, p) in parents:
                continue
            seen = [q for x, q in parents if x == i and q is not None]
            out.add((table, p, i, "gone" if any(q < p for q in seen) else "early" if any(q > p for q in seen) else "unknown"))
    return sorted(out)


def test_against_brute_force_in_any_delivery_order(spark, rows):
    rng = random.Random(3)
    ids = [*"abcdef", "a ", "é", None]
    parents = {(i, p) for i in ids for p in range(1, 6) if rng.random() < 0.4}
    refs = {t: [(rng.choice(ids), rng.randint(1, 5)) for _ in range(60)] for t in TABLES}
    once = advance(None, deliveries(df(spark, list(parents)), {t: [df(spark, r)] for t, r in refs.items()}, TABLES))
    want = brute(parents, refs)
    assert rows(orphans(once, TABLES)) == want
    state = None
    for p in (4, 1, 5, 2, 3, 3):  # a period's rows at a time, out of order, one twice
        at = lambda r: df(spark, [x for x in r if x[1] == p])  # noqa: E731,B023
        state = advance(state, deliveries(at(parents), {t: [at(r)] for t, r in refs.items()}, TABLES))
    assert rows(orphans(state, TABLES)) == want
    assert sum(r.n for r in orphan_counts(orphans(state, TABLES)).collect()) == len(want)


def test_arrival_resolves_and_deletion_reopens(spark, rows):
    state = advance(None, deliveries(None, {"edges": [df(spark, [("x", 1)])]}, TABLES))
    assert rows(orphans(state, TABLES)) == [("edges", 1, "x", "unknown")]
    state = advance(state, deliveries(df(spark, [("x", 1)]), {}, TABLES))
    assert rows(orphans(state, TABLES)) == []
    state = advance(state, deliveries(df(spark, [("x", 2)]), {}, TABLES), deleted=df(spark, [("x", 1)]))
    assert rows(orphans(state, TABLES)) == [("edges", 1, "x", "early")]


def test_empty(spark):
    assert orphans(advance(None, deliveries(df(spark, []), {"edges": [df(spark, [])]}, TABLES)), TABLES).collect() == []


def test_stream(spark, rows, tmp_path):
    src = str(tmp_path / "in")
    stream = OrphanStream(spark, str(tmp_path / "state"), TABLES)
    batches = [[("x", 1, 2, 0), ("y", 1, 4, 0)], [("x", 1, 1, 0)], [("x", 1, 0, 1), ("z", 2, 2, 0)]]
    seen = []
    for b, data in enumerate(batches):
        spark.createDataFrame(data, "id string, period int, bits int, gone int").coalesce(1).write.mode("append").parquet(src)
        df_ = spark.readStream.schema("id string, period int, bits int, gone int").parquet(src)
        stream.start(df_, str(tmp_path / "check")).awaitTermination()
        seen.append(rows(stream.open_references()))
    assert seen == [
        [("edges", 1, "x", "unknown"), ("metrics", 1, "y", "unknown")],
        [("metrics", 1, "y", "unknown")],
        [("edges", 1, "x", "unknown"), ("edges", 2, "z", "unknown"), ("metrics", 1, "y", "unknown")],
    ]
    assert list(itertools.chain(*seen))
