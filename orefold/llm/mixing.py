"""A training mix with target shares of tokens, fitted by a bounded knapsack over token lengths."""

from __future__ import annotations
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.llm.tokenizer import TOKENIZER_DIR, VOCABULARY, encode_column
from orefold.runtime import materialize, sorted_runs, spread_join

#: Tokens that the exact part of the fit starts with, beyond the longest document.
FIRST_WINDOW = 1_024

PLAN_SCHEMA = "key string, n_tokens bigint, n_docs bigint, repeats int, extra bigint"


def source_key(source: Column) -> Column:
    """A source's letters alone, in lower case."""
    return F.lower(F.regexp_replace(source, r"[^\p{L}]", ""))


def fit_budget(lengths: dict[int, int], budget: int, max_repeats: int) -> tuple[int, dict[int, int]]:
    """(r, {length: k}): every document r times, and k documents of each length once more, so that the tokens come as close
    to the budget as can be from below, and none is repeated more than max_repeats times.

    lengths counts documents by length. What is left after the full rounds is taken in proportion from every length but for a window, which is an
    exact bounded knapsack over reachable sums. Should no sum fill the window, it grows until one does or until it is all that is left, so the
    result is the best there is. Memory is five bytes a token of the window.
    """
    total = sum(n * c for n, c in lengths.items())
    if total == 0 or total * max_repeats <= budget:
        return max_repeats, {}
    rounds, left = divmod(max(budget, 0), total)
    unit = gcd(*(n for n in lengths if n))
    free = {n // unit: c for n, c in lengths.items() if n > 0}
    left //= unit
    window = FIRST_WINDOW
    while True:
        bulk = max(0, left - window - max(free))
        taken, carry = {}, 0
        for n in sorted(free):  # shares are rounded as they add up, so no length is favoured
            want = free[n] * bulk + carry
            taken[n], carry = divmod(want, total // unit)
        rest = left - sum(n * k for n, k in taken.items())
        sums, more = subset_sum({n: free[n] - k for n, k in taken.items()}, rest)
        if sums == rest or bulk == 0:
            return rounds, {n * unit: taken[n] + more.get(n, 0) for n in free if taken[n] + more.get(n, 0)}
        window *= 4


def subset_sum(free: dict[int, int], most: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to `most` of the free numbers (number: how often), and how often each one is in it."""
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    first = np.full(most + 1, -1, np.int32)  # the step that reached a sum first; what is below it needs earlier steps only
    steps: list[tuple[int, int]] = []
    for n in sorted(free, reverse=True):
        left, part = min(free[n], most // n), 1
        while left > 0 and not reached[most]:
            k = min(part, left)
            w = n * k
            new = reached[: most + 1 - w] & ~reached[w:]
            first[w:][new] = len(steps)
            reached[w:] |= new
            steps.append((n, k))
            left, part = left - k, part * 2
    best = at = int(np.flatnonzero(reached)[-1])
    used: dict[int, int] = {}
    while at:
        n, k = steps[first[at]]
        used[n] = used.get(n, 0) + k
        at -= n * k
    return best, used


def size_documents(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc, key and n_tokens of the documents whose source is a target; written once, since everything else reads it."""
    keys = targets.select(source_key(F.col("source")).alias("key")).where("key <> ''").distinct()
    keyed = docs.select(doc, "text", source_key(F.col("source")).alias("key")).where("key IS NOT NULL")
    wanted = spread_join(keyed, keys, ["key"], "left_semi")
    return materialize(encode_column(wanted, [doc, "key"], vocabulary=vocabulary, folder=folder, ids=False), "sizes")


def plan_mix(sizes: DataFrame, targets: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(plan, report) of the largest mix, up to all tokens of the targets' documents, in which every source that has documents can have its share.

    With `whole` the mix is as large as all tokens instead, and sources that can't fill their shares give all they may.
    plan (PLAN_SCHEMA): per source key and token length, how often each document comes and how many come once more. One task fits one source
    from its count of documents by length; the lengths number at most the longest document's tokens, whatever the number of documents. report: per row of targets the
    available tokens, `budget`, reached tokens and share of the mix, and `short`: whether tokens * max_repeats are fewer than target_share * all tokens. A source without
    documents has 0 tokens and doesn't hold the others back; null shares count as 0, null max_repeats as 1.
    """
    spec = targets.select(
        "source",
        source_key(F.col("source")).alias("key"),
        F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats"), F.lit(1)).alias("max_repeats"),
    )
    counts = materialize(sizes.groupBy("key", "n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    by_key = counts.groupBy("key").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.sum("n_docs").alias("docs"))
    everything = by_key.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))  # one row
    known = spec.join(by_key, "key", "left").crossJoin(everything).na.fill(0, ["tokens", "docs"])
    reach = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    size = known.agg(F.least(F.max("all_tokens"), F.max("all_tokens") if whole else F.min(reach)).alias("size"))  # one row; least passes over nulls
    budgets = known.crossJoin(size).withColumn("budget", F.floor(F.col("target_share") * F.col("size") + 1e-6)).drop("size")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = {int(n): int(c) for n, c in zip(pdf["n_tokens"], pdf["n_docs"])}
        rounds, extra = fit_budget(lengths, int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0]))
        rows = [(pdf["key"].iloc[0], n, c, rounds, extra.get(n, 0)) for n, c in lengths.items()]
        return pd.DataFrame(rows, columns=["key", "n_tokens", "n_docs", "repeats", "extra"])

    plan = counts.join(budgets.select("key", "budget", "max_repeats").dropDuplicates(["key"]), "key").groupBy("key").applyInPandas(fit, PLAN_SCHEMA)
    reached = plan.groupBy("key").agg(F.sum(F.col("n_tokens") * (F.col("n_docs") * F.col("repeats") + F.col("extra"))).alias("reached"))
    report = budgets.join(reached, "key", "left").na.fill(0, ["reached"])
    mixed = reached.agg(F.sum("reached").alias("mixed"))
    report = report.crossJoin(mixed).select(
        "source", "target_share", "max_repeats", "docs", "tokens", "all_tokens", "budget", F.col("reached").alias("reached_tokens"),
        (F.col("reached") / F.when(F.col("mixed") > 0, F.col("mixed"))).alias("reached_share"),
        (F.col("tokens") * F.col("max_repeats") < F.col("target_share") * F.col("all_tokens")).alias("short"),
    )
    return plan, report


def select_documents(sizes: DataFrame, plan: DataFrame, doc: str = "doc_id", seed: int = 17) -> DataFrame:
    """The mix: doc, key, n_tokens and repeats (1 or more) of each chosen document.

    Where only some documents of a length come once more, those with the smallest seeded hashes do; ranks within a length come from a
    distributed sort, so a length that very many documents have is no hot group. Rows that share a doc id are chosen together.
    """
    rows = spread_join(sizes, plan, ["key", "n_tokens"])
    some = rows.where("extra > 0 AND extra < n_docs").withColumn("__at", F.struct(F.xxhash64(F.lit(seed), doc).alias("h"), F.col(doc).alias("d")))
    ranks = sorted_runs(some.groupBy("key", "n_tokens", "extra", "__at").agg(F.count("*").alias("cnt")), ["key", "n_tokens", "extra"], "__at", "mix")
    more = ranks.where("below < extra").select(F.col("__at.d").alias(doc), F.lit(1).alias("__more"))
    whole = rows.where("extra = 0 OR extra >= n_docs").select(doc, "key", "n_tokens", (F.col("repeats") + (F.col("extra") > 0).cast("int")).alias("repeats"))
    part = some.join(more, doc, "left").select(doc, "key", "n_tokens", (F.col("repeats") + F.coalesce("__more", F.lit(0))).alias("repeats"))
    return whole.unionByName(part).where("repeats > 0")
