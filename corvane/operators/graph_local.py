"""Graph metrics that live within weakly connected components, many components to a task.

Call graphs fall into very many small components with long ways through them.  Rounds
over the whole table would be as many as the longest way; here whole components are
packed into tasks, and only components of more than ``local_rows`` links take the
rounds of ``graph`` and ``hierarchy``.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import graph as G
from .hierarchy import LOCAL_ROWS, _groups, strong_groups, with_components

Kernel = Callable[[list[int], list[list[int]], list[float]], list[tuple]]


def _packed(nodes: DataFrame, edges: DataFrame, value: str | None, local_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (comp, src, dst, vs, vd) of small components and lone nodes; nodes and edges of large ones; all with components."""
    n = nodes.select("node", (F.col(value) if value else F.lit(0.0)).cast("double").alias("v"))
    e = edges.select("src", "dst").distinct()
    linked = e.join(n.select(F.col("node").alias("src"), F.col("v").alias("vs")), "src").join(n.select(F.col("node").alias("dst"), F.col("v").alias("vd")), "dst").select("src", "dst", "vs", "vd")
    rows = cut(with_components(linked, ["src"]))
    big = cut(rows.groupBy("comp").agg(F.count("*").alias("_n")).filter(F.col("_n") > local_rows).select("comp"))
    alone = n.join(rows.select(F.col("src").alias("node")).union(rows.select("dst")).distinct(), "node", "left_anti").select(F.col("node").alias("comp"), F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.col("v").alias("vs"), F.lit(None).cast("double").alias("vd"))
    small = rows.select("comp", "src", "dst", "vs", "vd").join(F.broadcast(big), "comp", "left_anti").unionByName(alone)
    large = rows.join(F.broadcast(big), "comp", "left_semi")
    large_nodes = large.select(F.col("src").alias("node"), F.col("vs").alias("v")).union(large.select("dst", "vd")).distinct()
    return small, large_nodes, large.select("src", "dst"), rows


def _run(small: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """The kernel's rows of each component: kernel(ids in order, targets by index, values)."""
    types = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
            return made

        def one(links: list[tuple[int, int | None]], values: dict[int, float]) -> None:
            ids = sorted(values)
            at = {x: i for i, x in enumerate(ids)}
            out: list[list[int]] = [[] for _ in ids]
            for u, v in links:
                if v is not None:
                    out[at[u]].append(at[v])
            for x in out:
                x.sort()
            done.extend(kernel(ids, out, [values[x] for x in ids]))

        comp, links, values = None, [], {}
        for b in batches:
            for c, u, v, x, y in zip(*(b.column(k).to_pylist() for k in ("comp", "src", "dst", "vs", "vd")), strict=True):
                if c != comp and links:
                    one(links, values)
                    links, values = [], {}
                    if len(done) >= 20_000:
                        yield flush()
                comp = c
                links.append((u, v))
                values[u] = x
                if v is not None:
                    values[v] = y
        if links:
            one(links, values)
        if done:
            yield flush()

    n = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.repartition(n, "comp").sortWithinPartitions("comp").mapInArrow(solve, schema)


def _ranked(ids: list[int], out: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Group of each node, least id and longest way from a source of each group."""
    group, n = _groups(len(ids), out)
    name = [0] * n
    for i in range(len(ids) - 1, -1, -1):
        name[group[i]] = ids[i]
    rank = [0] * n
    for i in sorted(range(len(ids)), key=lambda i: -group[i]):  # a group's number is above those it leads to
        for j in out[i]:
            if group[j] != group[i] and rank[group[j]] < rank[group[i]] + 1:
                rank[group[j]] = rank[group[i]] + 1
    return group, name, rank


def _scc_kernel(ids: list[int], out: list[list[int]], _: list[float]) -> list[tuple]:
    group, name, rank = _ranked(ids, out)
    return [(x, name[group[i]], rank[group[i]]) for i, x in enumerate(ids)]


def strong_components(nodes: DataFrame, edges: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(node, scc, rank): strongly connected group by its least node, and the longest way to it from a source group."""
    small, big_nodes, big_edges, _ = _packed(nodes, edges, None, local_rows)
    out = _run(small, _scc_kernel, "node bigint, scc bigint, rank int")
    if big_nodes.isEmpty():
        return out
    scc = cut(strong_groups(big_nodes.select("node", F.col("node").alias("ord")), big_edges))
    return out.unionByName(scc.join(G.condensation_rank(scc, big_edges), "scc").select("node", "scc", "rank"))


def _core_kernel(ids: list[int], out: list[list[int]], _: list[float]) -> list[tuple]:
    near: list[set[int]] = [set() for _ in ids]
    for u, vs in enumerate(out):
        for v in vs:
            if u != v:
                near[u].add(v)
                near[v].add(u)
    degree = [len(x) for x in near]
    core, left, k = [0] * len(ids), set(range(len(ids))), 0
    while left:
        todo = [i for i in left if degree[i] <= k]
        if not todo:
            k = min(degree[i] for i in left)
            continue
        while todo:
            i = todo.pop()
            if i not in left:
                continue
            left.discard(i)
            core[i] = k
            for j in near[i]:
                if j in left:
                    degree[j] -= 1
                    if degree[j] <= k:
                        todo.append(j)
    return [(x, core[i]) for i, x in enumerate(ids)]


def cores(nodes: DataFrame, edges: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(node, core) as ``graph.k_core``."""
    small, big_nodes, big_edges, _ = _packed(nodes, edges, None, local_rows)
    out = _run(small, _core_kernel, "node bigint, core int")
    return out if big_nodes.isEmpty() else out.unionByName(G.k_core(big_nodes, big_edges))


def _walk_kernel(ids: list[int], out: list[list[int]], seeds: list[float]) -> list[tuple]:
    dist = {i: 0 for i, s in enumerate(seeds) if s}
    queue = list(dist)
    for i in queue:
        for j in out[i]:
            if j not in dist:
                dist[j] = dist[i] + 1
                queue.append(j)
    return [(x, dist.get(i, -1)) for i, x in enumerate(ids)]


def walks(nodes: DataFrame, edges: DataFrame, seed: str, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(node, dist) as ``graph.distances`` from the nodes whose Boolean column ``seed`` is true."""
    marked = nodes.withColumn("_s", F.coalesce(F.col(seed), F.lit(False)).cast("double"))
    small, big_nodes, big_edges, _ = _packed(marked, edges, "_s", local_rows)
    out = _run(small, _walk_kernel, "node bigint, dist int")
    return out if big_nodes.isEmpty() else out.unionByName(G.distances(big_nodes, big_edges, big_nodes.filter("v > 0")))


def component_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): weakly connected component by its least node."""
    e = cut(with_components(edges.select("src", "dst").distinct(), ["src"]))
    ends = e.select(F.col("src").alias("node"), "comp").union(e.select("dst", "comp")).distinct()
    # contraction names a component by its least end already
    return nodes.select("node").distinct().join(ends, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def compound(nodes: DataFrame, edges: DataFrame, score: str, cycle: float = 1.0, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(node, score) as ``graph.compound_score``; a null own score counts as 0."""

    def kernel(ids: list[int], out: list[list[int]], own: list[float]) -> list[tuple]:
        group, _ = _groups(len(ids), out)
        got = [0.0] * len(ids)
        for i in sorted(range(len(ids)), key=lambda i: group[i]):  # what a node leads to comes first
            below = [cycle if group[j] == group[i] else got[j] for j in out[i]]
            got[i] = own[i] * (0.6 + 0.4 * sum(below) / len(below)) if below else own[i]
        return [(x, got[i]) for i, x in enumerate(ids)]

    scored = nodes.withColumn("_o", F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
    small, big_nodes, big_edges, _ = _packed(scored, edges, "_o", local_rows)
    out = _run(small, kernel, "node bigint, score double")
    if big_nodes.isEmpty():
        return out
    scc = cut(strong_groups(big_nodes.select("node", F.col("node").alias("ord")), big_edges))
    return out.unionByName(G.compound_score(big_nodes, big_edges, "v", scc, G.condensation_rank(scc, big_edges), cycle).select("node", "score"))
