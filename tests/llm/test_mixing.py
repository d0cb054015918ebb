import random

import pytest
from pyspark.sql import functions as F

from orefold.llm.mixing import fit_budget, plan_mix, select_documents, size_documents, source_key, subset_sum


def best_sum(lengths, budget):
    sums = {0}
    for n, c in lengths.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    return max(s for s in sums if s <= budget)


def test_budget_is_met_as_closely_as_can_be():
    rng = random.Random(2)
    for _ in range(200):
        lengths = {rng.randint(0, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        total, most = sum(n * c for n, c in lengths.items()), rng.randint(1, 4)
        budget = rng.randint(0, max(1, int(total * most * 1.2)))
        rounds, extra = fit_budget(lengths, budget, most)
        reached = rounds * total + sum(n * k for n, k in extra.items())
        assert all(0 <= k <= lengths[n] for n, k in extra.items()) and rounds + bool(extra) <= most
        if total == 0 or total * most <= budget:
            assert rounds == most and not extra
        else:
            assert reached <= budget
            assert reached == rounds * total + best_sum(lengths, budget - rounds * total)


def test_large_budgets_stay_exact():
    lengths = {n: 1000 for n in range(1, 400)}
    total = sum(n * c for n, c in lengths.items())
    rounds, extra = fit_budget(lengths, total * 3 // 2 + 7, 5)
    assert rounds * total + sum(n * k for n, k in extra.items()) == total * 3 // 2 + 7
    share = [extra.get(n, 0) / 1000 for n in lengths]
    assert max(share) - min(share) < 0.05  # no length is favoured


def test_the_window_grows_until_the_best_sum():
    lengths = {6_000: 50, 10_000: 40, 15_000: 3, 1: 2}  # sums are 0, 1 or 2 beyond multiples of 1,000
    rounds, extra = fit_budget(lengths, 399_777, 1)
    assert (rounds, sum(n * k for n, k in extra.items())) == (0, 399_002)
    assert subset_sum({4: 2, 6: 1}, 13) == (10, {6: 1, 4: 1})


def test_mix(spark):
    rng = random.Random(3)
    spell = ["wiki", "Wiki", " WI-KI ", "w_i_k_i"]
    text = lambda n: " word" * n
    docs = [(i, text(rng.randint(1, 60)), rng.choice(spell), "x") for i in range(300)] + [(1000 + i, text(20), "notes", "x") for i in range(60)]
    docs += [(2000, text(50), None, "x"), (2001, None, "wiki", "x"), (2002, "", "notes", "x"), (2003, text(9), "other", "x"), (2004, text(5), "rare", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("wiki", 0.5, 2), ("notes", 0.3, 4), ("rare", 0.1, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    sizes = size_documents(df, targets)
    plan, report = plan_mix(sizes, targets)
    r = {x.source: x for x in report.collect()}
    assert {s for s, x in r.items() if x.short} == {"rare", "absent"} and (r["absent"].tokens, r["absent"].reached_tokens) == (0, 0)
    assert r["wiki"].docs == 301 and r["notes"].docs == 61
    full_plan, full_report = plan_mix(sizes, targets, whole=True)
    full = {x.source: x for x in full_report.collect()}
    # the rare source holds the mix to a size in which everyone has their share; with whole it gives all it may
    assert r["rare"].reached_tokens == r["rare"].tokens * 2 == r["rare"].budget and full["rare"].reached_tokens == full["rare"].tokens * 2 < full["rare"].budget
    assert full["wiki"].budget - full["wiki"].reached_tokens <= 1 and r["wiki"].budget == r["rare"].budget * 5 < full["wiki"].budget
    for some_plan, some in ((plan, r), (full_plan, full)):
        mix = select_documents(sizes, some_plan).collect()
        per = {}
        for m in mix:
            per[m.key] = per.get(m.key, 0) + m.n_tokens * m.repeats
        for s in ("wiki", "notes", "rare"):
            assert per.get(s, 0) == some[s].reached_tokens <= some[s].budget and max((m.repeats for m in mix if m.key == s), default=0) <= some[s].max_repeats
        assert sum(x.reached_share for x in some.values()) == pytest.approx(1)
        assert len(mix) == len({m.doc_id for m in mix})
        again = select_documents(sizes, some_plan).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, mix))


def test_empty_and_keys(spark):
    targets = spark.createDataFrame([("a b", 1.0, None)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    sizes = size_documents(df, targets)
    plan, report = plan_mix(sizes, targets)
    assert [(x.tokens, x.short, x.reached_share) for x in report.collect()] == [(0, False, None)] and select_documents(sizes, plan).collect() == []
    one = spark.createDataFrame([("Rev\u200bIEW-2 é",)], "s string").select(source_key(F.col("s"))).first()[0]
    assert one == "reviewé"
