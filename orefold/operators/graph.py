"""Strongly connected components and reachability of directed graphs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.runtime import discard, materialize, sorted_runs

#: Edges a single task takes; the contract's ceiling for one run's graph. Larger graphs are solved by the whole cluster.
TASK_EDGES = 1_000_000
#: Bytes for one block of reachability bits.
BLOCK_BYTES = 64 << 20
#: Rows (component, word of 64 targets) that one block of the distributed reachability may have.
BLOCK_ROWS = 64_000_000


def components(n: int, out: list[list[int]]) -> tuple[list[int], int]:
    """Component number of each node 0..n-1, in reverse topological order (edges between components go to smaller numbers), and their count."""
    index, low, comp = [0] * n, [0] * n, [-1] * n
    stack: list[int] = []
    seen = count = 0
    for root in range(n):
        if index[root]:
            continue
        todo = [(root, 0)]
        while todo:
            v, i = todo.pop()
            if i == 0:
                seen += 1
                index[v] = low[v] = seen
                stack.append(v)
            neighbours = out[v]
            while i < len(neighbours):
                w = neighbours[i]
                i += 1
                if not index[w]:
                    todo += [(v, i), (w, 0)]
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        comp[w] = count
                        if w == v:
                            break
                    count += 1
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
    return comp, count


def reach_weights(count: int, below: list[set[int]], size: list[int]) -> list[int]:
    """For each component the nodes in components it reaches, itself included; below holds its direct successors, which have smaller numbers.

    Reached sets are bit sets, one block of target components at a time, so memory stays bounded for any graph.
    """
    total = [0] * count
    width = max(64, min(count, BLOCK_BYTES * 8 // max(1, count)))
    for first in range(0, count, width):
        bits = [0] * count
        block = size[first : first + width]
        plain = all(s == 1 for s in block)
        for c in range(first, count):
            b = 1 << (c - first) if c < first + width else 0
            for d in below[c]:
                b |= bits[d]
            bits[c] = b
            if b:
                total[c] += b.bit_count() if plain else sum(s for i, s in enumerate(block) if b >> i & 1)
    return total


def analyse(nodes: Sequence, pairs: Sequence[tuple], reach: bool = True) -> list[tuple]:
    """(node, component, cyclic size, reachable, dependents) of every node.

    cyclic size is the size of the node's component if it has more than one node or a self-loop, else 0; reachable and dependents
    count other nodes by paths along and against the edges (None without reach). Ends of edges that are no nodes are added.
    """
    at = {v: i for i, v in enumerate(dict.fromkeys([*nodes, *(x for p in pairs for x in p)]))}
    names = list(at)
    out: list[list[int]] = [[] for _ in names]
    loops = set()
    for a, b in dict.fromkeys(pairs):
        out[at[a]].append(at[b])
        if a == b:
            loops.add(at[a])
    comp, count = components(len(names), out)
    size = [0] * count
    for c in comp:
        size[c] += 1
    forward = backward = None
    if reach:
        below: list[set[int]] = [set() for _ in range(count)]
        above: list[set[int]] = [set() for _ in range(count)]
        for v, targets in enumerate(out):
            for w in targets:
                if comp[v] != comp[w]:
                    below[comp[v]].add(comp[w])
                    above[count - 1 - comp[w]].add(count - 1 - comp[v])
        forward = reach_weights(count, below, size)
        backward = reach_weights(count, above, size[::-1])[::-1]
    first: dict[int, object] = {}
    for v, c in enumerate(comp):
        first[c] = names[v] if c not in first or names[v] < first[c] else first[c]
    return [
        (names[v], first[c], size[c] if size[c] > 1 or v in loops else 0, forward[c] - 1 if reach else None, backward[c] - 1 if reach else None)
        for v, c in enumerate(comp)
    ]


def graph_measures(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], node: str = "node", source: str = "from_id", target: str = "to_id", reach: bool = True) -> DataFrame:
    """Per graph (keys) and node: component (its smallest node), cyclic_size, reachable and dependents.

    One task solves one graph of up to TASK_EDGES distinct edges. Larger graphs, if there are any, get their components from
    distributed_components and the counts from distributed_reach, with the same results; the counts' work is quadratic in the components.
    Without reach, reachable and dependents are null. Edges with a null end are left out; nodes without edges have themselves as component,
    size 0 and nothing reachable.
    """
    pairs = edges.select(*keys, F.col(source).alias("s"), F.col(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL").distinct()
    pairs = materialize(pairs, "edges")
    large = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > TASK_EDGES).select(*keys)
    has_large = large.limit(1).count() > 0
    alone = nodes.select(*keys, F.col(node).alias("s"), F.lit(None).cast("string").alias("t")).where("s IS NOT NULL").distinct()
    if has_large:
        big = pairs.join(large, list(keys), "left_semi")
        pairs = pairs.join(large, list(keys), "left_anti")
        big_nodes = alone.join(large, list(keys), "left_semi")
        alone = alone.join(large, list(keys), "left_anti")
    # only nodes without any edge are sent as such
    ends = pairs.select(*keys, F.explode(F.array("s", "t")).alias("s")).distinct()
    alone = alone.join(ends, [*keys, "s"], "left_anti")
    names = [*keys, "node", "component", "cyclic_size", "reachable", "dependents"]
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"node {kinds[source]}", f"component {kinds[source]}", "cyclic_size bigint", "reachable bigint", "dependents bigint"])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = analyse([], list(zip(pdf["s"], pdf["t"])), reach)
        return pd.DataFrame([(*key, *r) for r in rows], columns=names)

    found = pairs.groupBy(*keys).applyInPandas(solve, schema)
    zero = F.lit(0 if reach else None).cast("bigint")
    lonely = alone.select(*keys, F.col("s").alias("node"), F.col("s").alias("component"), F.lit(0).cast("bigint").alias("cyclic_size"), zero.alias("reachable"), zero.alias("dependents"))
    out = found.unionByName(lonely)
    if has_large:
        solved = materialize(distributed_components(big, big_nodes, keys), "components")
        if reach:
            solved = distributed_reach(big, solved, keys)
        else:
            solved = solved.withColumns({c: F.lit(None).cast("bigint") for c in ("reachable", "dependents")})
        out = out.unionByName(solved.select(*names))
    return out


def _spread(values: DataFrame, edges: DataFrame, keys: Sequence[str], how) -> DataFrame:
    """The fixed point of v(t) = how(v(t), v(s)) along edges s -> t; values has keys, node and v."""
    while True:
        pushed = edges.join(values.withColumnRenamed("node", "s"), [*keys, "s"]).select(*keys, F.col("t").alias("node"), "v")
        merged = materialize(values.unionByName(pushed).groupBy(*keys, "node").agg(how("v").alias("v")), "spread")
        if merged.join(values.withColumnRenamed("v", "w"), [*keys, "node"]).where(~F.col("v").eqNullSafe(F.col("w"))).limit(1).count() == 0:
            return merged
        values = merged


def distributed_components(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of graphs of any size (pairs: keys, s, t; nodes: keys, s) by colouring.

    Every node takes the largest node that reaches it as its colour; what reaches the colour's own node within the colour is a
    component and is taken away. Each step is a join and an aggregation over the cluster; steps number the longest shortest path, per round.
    Columns: keys, node, component, cyclic_size.
    """
    every = nodes.select(*keys, F.col("s").alias("node")).unionByName(pairs.select(*keys, F.explode(F.array("s", "t")).alias("node"))).distinct()
    left, edges = materialize(every, "nodes"), pairs
    parts = []
    while left.limit(1).count():
        colour = _spread(left.withColumn("v", F.col("node")), edges, keys, F.max)
        of = lambda end: colour.select(*keys, F.col("node").alias(end), F.col("v").alias(f"{end}_c"))
        inside = materialize(edges.join(of("s"), [*keys, "s"]).join(of("t"), [*keys, "t"]).where("s_c = t_c").select(*keys, F.col("t").alias("s"), F.col("s").alias("t")), "inside")
        start = colour.select(*keys, "node", F.when(F.col("node") == F.col("v"), F.col("v")).alias("v"))
        back = _spread(start, inside, keys, F.max).where("v IS NOT NULL")
        parts.append(back.select(*keys, "node", F.col("v").alias("c")))
        gone = back.select(*keys, "node")
        left = materialize(left.join(gone, [*keys, "node"], "left_anti"), "nodes")
        keep = left.withColumnRenamed("node", "s")
        edges = materialize(edges.join(keep, [*keys, "s"], "left_semi").join(left.withColumnRenamed("node", "t"), [*keys, "t"], "left_semi").select(*keys, "s", "t"), "edges")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    sizes = found.groupBy(*keys, "c").agg(F.count("*").alias("n"), F.min("node").alias("component"))
    loops = pairs.where("s = t").select(*keys, F.col("s").alias("node"), F.lit(True).alias("loop"))
    joined = found.join(sizes, [*keys, "c"]).join(loops, [*keys, "node"], "left")
    return joined.select(*keys, "node", "component", F.when((F.col("n") > 1) | F.col("loop"), F.col("n")).otherwise(0).cast("bigint").alias("cyclic_size"))


def distributed_reach(pairs: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """found (keys, node, component, cyclic_size) with exact reachable and dependents, for graphs of any size (pairs: keys, s, t)."""
    sizes = found.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    numbered = sorted_runs(sizes.select(*keys, "component", F.lit(1).alias("cnt")), keys, "component", "numbers").select(*keys, "component", F.col("below").alias("c"))
    comps = materialize(sizes.join(numbered, [*keys, "component"]), "numbered")
    of = lambda end: found.join(comps, [*keys, "component"]).select(*keys, F.col("node").alias(end), F.col("c").alias(f"{end}_c"))
    arcs = pairs.join(of("s"), [*keys, "s"]).join(of("t"), [*keys, "t"]).where("s_c <> t_c").select(*keys, F.col("s_c").alias("s"), F.col("t_c").alias("t")).distinct()
    arcs = materialize(arcs, "arcs")
    counts = comps.select(*keys, "component", "c")
    for name, along in (("reachable", arcs), ("dependents", arcs.select(*keys, F.col("t").alias("s"), F.col("s").alias("t")))):
        counts = counts.join(_reached(along, comps, keys).withColumnRenamed("total", name), [*keys, "c"])
    counts = materialize(counts.drop("c"), "counts")
    return found.join(counts, [*keys, "component"])


def _reached(arcs: DataFrame, comps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`total`, the other nodes that each component c reaches along arcs s -> t of a graph without cycles.

    Reached sets are bit sets in words of 64 components, a block of words at a time. Only new bits are pushed against the arcs, until there are none.
    """
    words = comps.withColumns({"w": F.expr("c div 64"), "at": F.expr("cast(c % 64 as int)")})
    more = words.where("n > 1").groupBy(*keys, "w").agg(F.collect_list(F.struct("at", "n")).alias("more"))  # at most 64 each
    many, last = words.agg(F.count("*"), F.max("w")).first()
    width = max(1, BLOCK_ROWS // max(1, many))
    parts = []
    for first in range(0, (-1 if last is None else last) + 1, width):
        known = materialize(words.where(F.col("w").between(first, first + width - 1)).select(*keys, "c", "w", F.expr("shiftleft(1L, at)").alias("bits")), "known")
        fresh = known
        while True:
            pushed = arcs.join(fresh.withColumnRenamed("c", "t"), [*keys, "t"]).groupBy(*keys, F.col("s").alias("c"), "w").agg(F.bit_or("bits").alias("bits"))
            new = F.expr("bits & ~coalesce(old, 0L)")
            step = materialize(pushed.join(known.withColumnRenamed("bits", "old"), [*keys, "c", "w"], "left").withColumn("bits", new).where("bits <> 0").drop("old"), "fresh")
            if fresh is not known:
                discard(fresh)
            if step.limit(1).count() == 0:
                discard(step)
                break
            merged = materialize(known.unionByName(step).groupBy(*keys, "c", "w").agg(F.bit_or("bits").alias("bits")), "known")
            discard(known)
            known, fresh = merged, step
        weight = F.expr("bit_count(bits) + coalesce(aggregate(more, 0L, (a, x) -> a + (x.n - 1) * (shiftright(bits, x.at) & 1L)), 0L)")
        parts.append(materialize(known.join(more, [*keys, "w"], "left").groupBy(*keys, "c").agg(F.sum(weight).alias("total")), "reached"))
        discard(known)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys, "c").agg((F.sum("total") - 1).alias("total"))
