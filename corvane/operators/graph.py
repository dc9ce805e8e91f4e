"""Metrics of directed graphs.

``nodes`` has the column ``node``, ``edges`` has ``src`` and ``dst``; keys may be of any
type that can be compared.  Repeated edges count where a function says so.  Loops cut
their lineage each round, so the plan does not grow; every loop ends on its own or
after the given number of rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import entropy_of, ladder
from ..plans.lineage import cut
from ..plans.numbering import numbered
from ..plans.skew import salted_join


def internal(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node."""
    return edges.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")


def resolved(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst) of calls (src, label, addr): the node of the call's binary at its address, else the least node of any binary there, else null."""
    own = nodes.select("label", "addr", F.col("node").alias("_own")).dropna()
    anywhere = nodes.filter("addr is not null").groupBy("addr").agg(F.min("node").alias("_any"))
    here = salted_join(calls, own, ["label", "addr"], F.col("src"), "left")
    return salted_join(here, anywhere, ["addr"], F.col("src"), "left").select("src", F.coalesce("_own", "_any").alias("dst"))


def callers(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(nodes: DataFrame, edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(node, n_out, n_in); repeated edges count unless ``distinct``."""
    e = edges.select("src", "dst").distinct() if distinct else edges
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    return nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").na.fill(0, ["n_out", "n_in"])


def reciprocal_share(edges: DataFrame) -> DataFrame:
    """(n_edges, n_reciprocal, share) over distinct edges; an edge to itself is reciprocal."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_b"))
    return e.join(back, ["src", "dst"], "left").agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n_reciprocal")).withColumn("share", F.when(F.col("n_edges") > 0, F.col("n_reciprocal") / F.col("n_edges")).otherwise(F.lit(0.0)))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges a < b without loops."""
    return edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, k, triangles, cc): local clustering of the undirected graph; 0 below two neighbours.

    Triangles are listed from the end of lower degree, which bounds the pairs any
    single hub gives rise to.
    """
    u = cut(undirected(edges))
    deg = u.select(F.col("a").alias("node")).union(u.select("b")).groupBy("node").agg(F.count("*").alias("k"))
    da, db = deg.select(F.col("node").alias("a"), F.col("k").alias("ka")), deg.select(F.col("node").alias("b"), F.col("k").alias("kb"))
    low = F.struct("ka", "a") < F.struct(F.col("kb").alias("ka"), F.col("b").alias("a"))
    way = cut(u.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = way.alias("p").join(way.alias("q"), F.col("p.x") == F.col("q.x")).filter("p.y < q.y").select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    triangles = wedge.join(u, ["a", "b"]).select(F.explode(F.array("x", "a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    out = nodes.select("node").distinct().join(deg, "node", "left").join(triangles, "node", "left").na.fill(0, ["k", "triangles"])
    return out.withColumn("cc", F.when(F.col("k") >= 2, 2.0 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(F.lit(0.0)))


def k_core(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, core): the greatest k for which a node is in the k-core of the undirected graph.

    Peels all nodes under the current degree at once; k then goes on to the least
    degree left, so empty values of k cost no round.
    """
    u = undirected(edges)
    e = cut(u.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(u.select("b", "a")))
    left, done, k = cut(nodes.select("node").distinct()), None, 0
    while True:
        deg = cut(left.join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")), "node", "left").na.fill(0, ["d"]))
        least = deg.agg(F.min("d")).first()[0]
        if least is None:
            break
        k = max(k, least)
        off = deg.filter(F.col("d") <= k).select("node", F.lit(k).alias("core"))
        done = cut(off if done is None else done.union(off), *([done] if done is not None else []))
        rest = cut(deg.filter(F.col("d") > k).select("node"))
        e = cut(e.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), e)
        left = rest
    return done if done is not None else nodes.select("node", F.lit(0).alias("core")).limit(0)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): weakly connected components, named by their least node."""
    both = cut(edges.filter("src != dst").select("src", "dst").union(callers(edges).filter("src != dst").select("src", "dst")).distinct())
    state = cut(nodes.select("node", F.col("node").alias("comp")).distinct())
    while True:
        # the least name among the neighbours, then a jump to the name that this name has itself
        near = both.join(state.select(F.col("node").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("m"))
        step = state.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("new"))
        hop = step.select(F.col("node").alias("new"), F.col("new").alias("new2"))
        nxt = cut(step.join(hop, "new").select("node", F.least("new", "new2").alias("comp"), (F.least("new", "new2") != F.col("comp")).alias("moved")))
        more = not nxt.filter("moved").isEmpty()
        state = nxt.select("node", "comp")
        if not more:
            return state


def component_ranks(comps: DataFrame) -> DataFrame:
    """(node, comp, component_id, n): components numbered by size, largest first, ties by name."""
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n"))
    ranked = numbered(sizes, [F.desc("n"), F.col("comp")], "component_id")
    return comps.join(ranked, "comp").select("node", "comp", "component_id", "n")


def distances(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, dist): links from the nearest seed, -1 if none leads there."""
    e = cut(edges.select("src", "dst").distinct())
    front = cut(seeds.select("node").join(nodes.select("node"), "node", "left_semi").distinct().withColumn("dist", F.lit(0)))
    seen, d = front, 0
    while not front.isEmpty():
        d += 1
        front = cut(e.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(d).alias("dist")))
        seen = cut(seen.union(front))
    return nodes.select("node").distinct().join(seen, "node", "left").select("node", F.coalesce("dist", F.lit(-1)).alias("dist"))


def condensation_rank(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc, rank): the longest way from a source of the graph of strongly connected groups."""
    of = scc.select(F.col("node").alias("src"), F.col("scc").alias("a")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    e = cut(edges.join(of[0], "src").join(of[1], "dst").filter("a != b").select("a", "b").distinct())
    rank = cut(scc.select("scc").distinct().withColumn("rank", F.lit(0)))
    while True:
        told = e.join(rank.select(F.col("scc").alias("a"), F.col("rank").alias("r")), "a").groupBy(F.col("b").alias("scc")).agg(F.max(F.col("r") + 1).alias("t"))
        nxt = cut(rank.join(told, "scc", "left").select("scc", F.greatest("rank", F.coalesce("t", F.lit(0))).alias("rank"), (F.col("t") > F.col("rank")).alias("moved")))
        more = not nxt.filter("moved").isEmpty()
        rank = nxt.select("scc", "rank")
        if not more:
            return rank


#: Links and nodes up to which an iteration runs in one task; beyond, each round is joins over whole tables. Both give the same rows.
LOCAL_LINKS = 500_000


def _iterated(n: DataFrame, e: DataFrame, solve: Callable[[np.ndarray, np.ndarray, int], dict[str, np.ndarray]], columns: list[str]) -> DataFrame:
    """(node, columns) from ``solve``(source, target, number of nodes) with nodes by index, in one task."""
    kind = dict(n.dtypes)["node"]
    rows = n.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst")).unionByName(e.select("src", "dst")).coalesce(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat([pd.DataFrame({"src": [], "dst": []}), *batches])
        own, links = both.loc[both["dst"].isna(), "src"], both[both["dst"].notna()]
        names = pd.Index(own.sort_values())
        src, dst = names.get_indexer(links["src"].astype(own.dtype)), names.get_indexer(links["dst"].astype(own.dtype))
        known = (src >= 0) & (dst >= 0)
        yield pd.DataFrame({"node": names.to_numpy(), **solve(src[known], dst[known], len(names))})

    return rows.mapInPandas(run, f"node {kind}, " + ", ".join(f"{c} double" for c in columns))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-6, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, rank) over distinct edges; the rank of nodes without a way out is spread evenly."""
    e = cut(edges.select("src", "dst").distinct())
    n = cut(nodes.select("node").distinct())
    count = n.count()
    if not count:
        return n.withColumn("rank", F.lit(0.0))
    if e.count() + count <= local_links:

        def solve(src: np.ndarray, dst: np.ndarray, k: int) -> dict[str, np.ndarray]:
            out, rank = np.bincount(src, minlength=k), np.full(k, 1.0 / k)
            for _ in range(rounds):
                given = np.bincount(dst, rank[src] / out[src], minlength=k)
                new = alpha * (given + rank[out == 0].sum() / k) + (1 - alpha) / k
                change, rank = np.abs(new - rank).sum(), new
                if change < k * tolerance:
                    break
            return {"rank": rank}

        return _iterated(n, e, solve, ["rank"])
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    state = cut(n.join(out, "node", "left").withColumn("rank", F.lit(1.0 / count)))
    for _ in range(rounds):
        loose = state.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        given = e.join(state.select(F.col("node").alias("src"), (F.col("rank") / F.col("k")).alias("g")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("g").alias("g"))
        new = F.lit(alpha) * (F.coalesce("g", F.lit(0.0)) + loose / count) + (1 - alpha) / count
        nxt = cut(state.join(given, "node", "left").select("node", "k", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")), state)
        change = nxt.agg(F.sum("moved")).first()[0]
        state = nxt
        if change < count * tolerance:
            break
    return state.select("node", "rank")


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float = 1e-8, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, hub, authority), each adding up to 1, or 0 without edges."""
    e = cut(edges.select("src", "dst").distinct())
    n = cut(nodes.select("node").distinct())
    count = max(n.count(), 1)
    if e.count() + count <= local_links:

        def solve(src: np.ndarray, dst: np.ndarray, k: int) -> dict[str, np.ndarray]:
            hub, authority = np.full(k, 1.0 / max(k, 1)), np.zeros(k)
            for _ in range(rounds):
                authority = np.bincount(dst, hub[src], minlength=k)
                new = np.bincount(src, authority[dst], minlength=k)
                authority, new = authority / (authority.sum() or 1.0), new / (new.sum() or 1.0)
                change, hub = np.abs(new - hub).sum(), new
                if change < tolerance:
                    break
            return {"hub": hub, "authority": authority}

        return _iterated(n, e, solve, ["hub", "authority"])
    hub = n.withColumn("hub", F.lit(1.0 / count))
    state = None
    for _ in range(rounds):
        a = e.join(hub.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("authority"))
        h = e.join(a.select(F.col("node").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("h"))
        both = cut(n.join(a, "node", "left").join(h, "node", "left").na.fill(0.0, ["authority", "h"]).join(hub.withColumnRenamed("hub", "old"), "node"))
        sums = both.agg(F.sum("authority"), F.sum("h")).first()
        sa, sh = (sums[0] or 1.0) or 1.0, (sums[1] or 1.0) or 1.0
        state = both.select("node", (F.col("h") / sh).alias("hub"), (F.col("authority") / sa).alias("authority"), "old")
        if (state.agg(F.sum(F.abs(F.col("hub") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
        hub = state.select("node", "hub")
    return state.select("node", "hub", "authority")


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int | None = None) -> DataFrame:
    """(node, betweenness): shortest ways through a node over 1 / ((n-1)(n-2)).

    All sources, or a sample of ``sources`` by hash, scaled up.  The adjacency is
    broadcast, so at most ``BETWEENNESS_EDGES`` distinct edges are accepted; the sources
    are spread over the tasks.
    """
    import pandas as pd

    spark = nodes.sparkSession
    e = edges.filter("src != dst").select("src", "dst").distinct().limit(BETWEENNESS_EDGES + 1).collect()
    if len(e) > BETWEENNESS_EDGES:
        raise ValueError(f"more than {BETWEENNESS_EDGES} edges; sample the graph or take a component")
    out: dict = {}
    for r in e:
        out.setdefault(r["src"], []).append(r["dst"])
    held = spark.sparkContext.broadcast(out)
    start = nodes.select("node").distinct()
    n = start.count()
    taken = n if sources is None else min(n, sources)
    if sources is not None and sources < n:
        start = start.orderBy(F.xxhash64("node")).limit(sources)
    kind = dict(nodes.dtypes)["node"]

    def ways(batches):
        adj, total = held.value, {}
        for batch in batches:
            for s in batch["node"]:
                order, before, sigma, dist = [], {s: []}, {s: 1.0}, {s: 0}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in adj.get(v, ()):
                        if w not in dist:
                            dist[w], sigma[w], before[w] = dist[v] + 1, 0.0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            before[w].append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + delta[w]
        yield pd.DataFrame({"node": list(total), "b": list(total.values())})

    part = start.repartition(max(1, min(taken, 64))).mapInPandas(ways, f"node {kind}, b double").groupBy("node").agg(F.sum("b").alias("b"))
    scale = n / max(taken, 1) / max((n - 1) * (n - 2), 1)
    return nodes.select("node").distinct().join(part, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


BETWEENNESS_EDGES = 2_000_000


def refine(nodes: DataFrame, edges: DataFrame, label: str, depth: int = 3, external: str = "EXTERNAL") -> DataFrame:
    """``nodes`` with wl0..wl<depth>: labels refined by the sorted labels of the callees.

    A target that is no node counts as ``external``.  New labels are numbered in the
    order of the composed text.  A hub's callees are one list; it is as long as its
    number of calls.
    """
    out = nodes.select("node", F.col(label).alias("wl0"))
    for d in range(1, depth + 1):
        before = out.select(F.col("node").alias("dst"), F.col(f"wl{d - 1}").alias("_c"))
        near = edges.select("src", "dst").join(before, "dst", "left").groupBy(F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("_c", F.lit(external)))), ",").alias("_n"))
        joined = out.join(near, "node", "left").withColumn("_t", F.concat_ws("|", f"wl{d - 1}", F.coalesce("_n", F.lit(""))))
        names = numbered(joined.select("_t").distinct(), [F.col("_t")], "_i").select("_t", F.concat(F.lit(f"L{d}_"), F.col("_i").cast("string")).alias(f"wl{d}"))
        out = cut(joined.join(names, "_t").drop("_t", "_n"))
    return out


def pattern_name(own: Column, callees: Column) -> Column:
    """Name of a group from its own label and its top callee labels (array of label, share), both upper-case."""
    names = F.transform(callees, lambda c: c["label"])
    none = F.size(callees) == 0
    calls = lambda x: F.exists(names, lambda n: n.contains(x))
    return (
        F.when(own.contains("GUARD") & none, "PURE_GUARD").when(own.contains("GETTER") & none, "LEAF_GETTER").when(own.contains("READER") & calls("GUARD"), "GUARDED_READER")
        .when(own.contains("WRITER") & calls("READER"), "READ_THEN_WRITE").when(own.contains("CALLER") & calls("GUARD"), "GUARD_THEN_CALL").when(own.contains("CALLER") & none, "ISOLATED_CALLER")
        .when(none, F.concat(F.lit("LEAF_"), F.substring(own, 1, 8)))
        .when((F.size(callees) == 1) & (F.get(callees, F.lit(0))["share"] > 0.8), F.concat(F.substring(own, 1, 6), F.lit("→"), F.substring(F.get(names, F.lit(0)), 1, 6)))
        .otherwise(F.concat(F.substring(own, 1, 8), F.lit("_MIXED")))
    )


def callee_idf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, mean_idf, max_idf, utility): how special the callees are; 0, 0 and 0.5 without callees.

    The references to a target are counted with repeats.
    """
    n = nodes.select("node").distinct().agg(F.count("*").alias("N"))
    refs = edges.groupBy("dst").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("dst", F.log2(F.col("N") / F.col("c")).alias("idf"))
    mine = edges.join(refs, "dst").groupBy(F.col("src").alias("node")).agg(F.avg("idf").alias("m"), F.max("idf").alias("x"))
    out = nodes.select("node").distinct().join(mine, "node", "left").join(F.broadcast(n))
    return out.select("node", F.coalesce("m", F.lit(0.0)).alias("mean_idf"), F.coalesce("x", F.lit(0.0)).alias("max_idf"), F.when(F.col("m").isNull() | (F.col("N") <= 1), 0.5).otherwise(1 - F.col("m") / F.log2("N")).alias("utility"))


def caller_diversity(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(node, n_callers, diversity): entropy in bits of the callers' ``group``; 0 without callers."""
    who = edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("src"), F.col(group).alias("g")), "src").groupBy(F.col("dst").alias("node"), "g").agg(F.count("*").alias("c"))
    total = who.groupBy("node").agg(F.sum("c").alias("n_callers"))
    h = who.join(total, "node").groupBy("node").agg(entropy_of(F.col("c") / F.col("n_callers")).alias("diversity"), F.max("n_callers").alias("n_callers"))
    return nodes.select("node").distinct().join(h, "node", "left").select("node", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("diversity", F.lit(0.0)).alias("diversity"))


def noise(functions: DataFrame, distances: DataFrame) -> DataFrame:
    """(node, unreachable, common_only) of functions (fn_id, label, named_callees) and distances (node, dist) from seeds.

    A function calls common names only if it names others than FUN_ ones and all of these are
    so widely used in its binary that their IDF is below 0.65 of the greatest possible.
    """
    n = functions.groupBy("label").agg(F.count("*").alias("_n"))
    named = functions.select("fn_id", "label", F.explode("named_callees").alias("c")).filter("c is not null")
    k = named.groupBy("label", "c").agg(F.count("*").alias("_k"))
    own = salted_join(named.filter(~F.col("c").startswith("FUN_")), k.join(n, "label"), ["label", "c"], F.col("fn_id"))
    common = own.groupBy("fn_id").agg(F.bool_and(F.log2(F.col("_n") / F.col("_k")) < 0.65 * F.log2(F.greatest("_n", F.lit(2)))).alias("_lib"))
    return distances.join(common.withColumnRenamed("fn_id", "node"), "node", "left").select("node", (F.col("dist") < 0).alias("unreachable"), F.coalesce("_lib", F.lit(False)).alias("common_only"))


def utility(nodes: DataFrame, edges: DataFrame, component: str, kind: str, n_callers: str) -> DataFrame:
    """(node, utility): how much a function serves all others; 0 without callers.

    0.30 for the number of callers (full from a twentieth of all functions on), 0.40 for
    ordinary callees (a half without any), 0.30 for the greater of two diversities of its
    callers, by component and by kind, as shares of the greatest possible entropy.  Rare
    callees hold it at 0.30.  Repeated calls count.
    """
    total, k_comp, k_kind = nodes.agg(F.count("*"), F.count_distinct(component), F.count_distinct(kind)).first()
    n = max(total, 1)

    def diversity(group: str) -> DataFrame:
        who = edges.join(nodes.select(F.col("node").alias("src"), F.col(group).alias("g")), "src").groupBy(F.col("dst").alias("node"), "g").agg(F.count("*").alias("c"))
        t = who.groupBy("node").agg(F.sum("c").alias("t"))
        return who.join(t, "node").groupBy("node").agg(entropy_of(F.col("c") / F.col("t")).alias("h"))

    from math import log2

    by_comp, by_kind = diversity(component).withColumnRenamed("h", "_hc"), diversity(kind).withColumnRenamed("h", "_hk")
    refs = edges.groupBy("dst").agg(F.count("*").alias("c")).select("dst", F.log2(F.lit(n) / F.col("c")).alias("idf"))
    mean = salted_join(edges, refs, ["dst"], F.col("src")).groupBy(F.col("src").alias("node")).agg(F.avg("idf").alias("_m"))
    x = nodes.select("node", F.coalesce(n_callers, F.lit(0)).alias("_in")).join(by_comp, "node", "left").join(by_kind, "node", "left").join(mean, "node", "left")
    top = log2(max(n, 2))
    spread = F.greatest(F.coalesce("_hk", F.lit(0.0)) / log2(max(k_kind, 2)), F.coalesce("_hc", F.lit(0.0)) / log2(max(k_comp, 2)))
    raw = 0.30 * F.least(F.col("_in") / max(n * 0.05, 1), F.lit(1.0)) + 0.40 * F.when(F.col("_m").isNull(), 0.5).otherwise(1 - F.col("_m") / top) + 0.30 * spread
    return x.select("node", F.when(F.col("_in") == 0, 0.0).when(F.col("_m") > top * 0.60, F.least(raw, F.lit(0.30))).otherwise(raw).alias("utility"))


def component_summary(nodes: DataFrame, edges: DataFrame, comps: DataFrame, cores: DataFrame, hub: str) -> DataFrame:
    """(comp, n, n_edges, density, max_k, avg_degree, top_hub, role) of each component; ``hub`` orders the nodes."""
    u = undirected(edges).join(comps.select(F.col("node").alias("a"), "comp"), "a").groupBy("comp").agg(F.count("*").alias("n_edges"))
    own = comps.join(cores, "node").join(nodes.select("node", F.col(hub).alias("_h")), "node").groupBy("comp").agg(F.count("*").alias("n"), F.max("core").alias("max_k"), F.max_by("node", F.struct("_h", "node")).alias("top_hub"))
    out = own.join(u, "comp", "left").na.fill(0, ["n_edges"])
    n, e = F.col("n"), F.col("n_edges")
    out = out.withColumn("density", F.when(n > 1, 2.0 * e / (n * (n - 1))).otherwise(F.lit(0.0))).withColumn("avg_degree", 2.0 * e / n)
    role = ladder((n == 1, "SINGLETON"), ((n >= 50) & (F.col("max_k") >= 3), "DEEP_IMPL_CORE"), ((F.col("density") > 0.1) & (n <= 30), "TIGHT"), (F.col("avg_degree") < 1.5, "CHAIN"), (n >= 10, "ISLAND"), otherwise="MIXED")
    return out.withColumn("role", role)


def graph_rank(betweenness_: Column, size: Column, n_in: Column, noise: Column, seed: Column) -> Column:
    """How much a function is worth a look."""
    base = F.log(size + 1)
    return F.when(noise, 0.0).when(seed, base * 0.01).otherwise(betweenness_ * base / (n_in + 1))


def power_law(degree_counts: DataFrame) -> DataFrame:
    """(n, alpha, log_ratio) of a discrete power law fitted to non-zero degrees against an exponential; none below 20 degrees.

    Both likelihoods need three sums over the histogram (degree, n) only, whatever its size.
    """
    from math import exp, log

    spark = degree_counts.sparkSession
    d, c = F.col("degree"), F.col("n")
    n, logs, total = degree_counts.filter("degree > 0").agg(F.sum(c), F.sum(c * F.log(d.cast("double"))), F.sum(c * d)).first()
    if (n or 0) < 20:
        return spark.createDataFrame([], "n bigint, alpha double, log_ratio double")

    def zeta(s: float) -> float:
        return sum(k**-s for k in range(1, 2_000)) + 2_000 ** (1 - s) / (s - 1)

    like, alpha = max((-(1.01 + i * 0.01) * logs - n * log(zeta(1.01 + i * 0.01)), 1.01 + i * 0.01) for i in range(500))
    rate = log(1 + 1 / max(total / n - 1, 1e-9))
    other = n * log(1 - exp(-rate)) - rate * (total - n)
    return spark.createDataFrame([(n, alpha, like - other)], "n bigint, alpha double, log_ratio double")


def compound_score(nodes: DataFrame, edges: DataFrame, score: str, scc: DataFrame, rank: DataFrame, cycle: float = 1.0) -> DataFrame:
    """(node, score): own score times 0.6 + 0.4 of the callees' mean, from the last rank of the condensation up.

    A callee of the same strongly connected group counts as ``cycle``.
    """
    at = cut(nodes.select("node", F.col(score).alias("own")).join(scc, "node").join(rank, "scc"))
    links = cut(edges.select("src", "dst").distinct().join(at.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst"))
    top = at.agg(F.max("rank")).first()[0]
    done = None
    for r in range(top if top is not None else -1, -1, -1):
        level = at.filter(F.col("rank") == r)
        mine = links.join(level.select(F.col("node").alias("src")), "src", "left_semi")
        known = mine if done is None else mine.join(done.select(F.col("node").alias("dst"), F.col("score").alias("s")), "dst", "left")
        value = F.lit(cycle) if done is None else F.when(F.col("a") == F.col("b"), cycle).otherwise(F.col("s"))
        mean = known.groupBy(F.col("src").alias("node")).agg(F.avg(value).alias("m"))
        got = level.join(mean, "node", "left").select("node", F.when(F.col("m").isNull(), F.col("own")).otherwise(F.col("own") * (0.6 + 0.4 * F.col("m"))).alias("score"))
        done = cut(got if done is None else done.union(got))
    return done if done is not None else at.select("node", F.col("own").alias("score"))
