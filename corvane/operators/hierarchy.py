"""Parent-child links as full hierarchies.

Cycles are separated first: functions that can reach one another form one strongly
connected group, and a root is a group no other group leads into, represented by
its lowest node.  From each root the tree of shortest ways is labelled by heavy-path
decomposition: a node's heavy child has the largest subtree, heavy children carry
the chain on and all others begin one.  Depth and path are the chain segments above
a node laid end to end; preorder numbers that visit heavy children first make each
chain, and each subtree, one interval, so descendants are intervals too.

Weakly connected groups are found by contraction.  Groups of at most
``LOCAL_ROWS`` rows are packed many to a task; larger ones take the distributed
path, which holds no group in one task.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut

#: Nodes and edges of a weakly connected group that one task may hold.
LOCAL_ROWS = 200_000
SCHEMA = "grp string, root bigint, node bigint, depth int, parent bigint, chain bigint, chain_pos int, pre bigint, last bigint, on_cycle int"


def _find(parent: dict[int, int], x: int) -> int:
    while (up := parent[x]) != x:
        parent[x] = parent[up]
        x = up
    return x


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one partition with the least node each is connected to within it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    parent: dict[int, int] = {}
    for b in held:
        for u, v in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
            ru, rv = _find(parent, parent.setdefault(u, u)), _find(parent, parent.setdefault(v, v))
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
    for b in held:
        comp = pa.array([_find(parent, u) for u in b.column("src").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, comp], [*b.schema.names, "comp"])


def star_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of an undirected edge list (src, dst) by alternating large and small stars.

    ``comp`` is the least node of the component.  The number of rounds is logarithmic
    in the longest chain; each round cuts the lineage and drops the table before.
    """
    e = cut(edges.select("src", "dst").distinct())
    whole = e
    seen = None
    while True:
        both = e.union(e.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        down = large.filter("src != dst").distinct()
        small_m = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(small_m, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(small_m.select("src", F.col("m").alias("dst")))
        nxt = cut(small.filter("src != dst").distinct(), *([e] if e is not whole else []))
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        e = nxt
        if state == seen:
            break
        seen = state
    nodes = whole.select(F.col("src").alias("node")).union(whole.select("dst")).distinct()
    return nodes.join(e.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("dst", "node").alias("comp"))


def with_components(edges: DataFrame, near: list[str]) -> DataFrame:
    """``edges`` (src, dst bigint, and more) with the bigint column ``comp`` of their weakly connected group.

    Edges are first contracted within partitions ranged by ``near``, columns by which
    connected nodes tend to lie together; only nodes that lie in several partitions
    are left to the distributed rounds.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields)
    local = cut(edges.repartitionByRange(n, *near).mapInArrow(_contract, schema + ", comp bigint"))
    ends = local.select(F.col("src").alias("node"), "comp").union(local.select("dst", "comp")).groupBy("node").agg(F.min("comp").alias("lo"), F.collect_set("comp").alias("all"))
    links = ends.filter(F.size("all") > 1).select(F.explode("all").alias("src"), F.col("lo").alias("dst")).filter("src != dst").distinct()
    links = cut(links)
    if links.isEmpty():
        merged = local
    else:
        final = star_components(links).select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
        merged = local.join(final, "comp", "left").select(*edges.columns, F.coalesce("_to", "comp").alias("comp"))
    return merged


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def _groups(n: int, out: list[list[int]]) -> tuple[list[int], int]:
    """Strongly connected group of each node, numbered so that a group comes after all it leads to."""
    index, low, group = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    on, count, groups = [False] * n, 0, 0
    for s in range(n):
        if index[s] >= 0:
            continue
        work = [(s, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            edges, deeper = out[v], False
            while i < len(edges):
                w = edges[i]
                i += 1
                if index[w] < 0:
                    work.append((v, i))
                    work.append((w, 0))
                    deeper = True
                    break
                if on[w] and index[w] < low[v]:
                    low[v] = index[w]
            if deeper:
                continue
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    on[w] = False
                    group[w] = groups
                    if w == v:
                        break
                groups += 1
            if work and low[v] < low[work[-1][0]]:
                low[work[-1][0]] = low[v]
    return group, groups


def heavy_paths(root: int, out: list[list[int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(node, depth, parent, chain head, position in the chain, preorder number, last number below) from ``root``.

    The tree is that of fewest links, ties to the parent that comes first.
    """
    parent, order, level = {root: -1}, [root], [root]
    while level:
        found = []
        for v in level:
            for w in out[v]:
                if w not in parent:
                    parent[w] = v
                    found.append(w)
        found.sort()
        order += found
        level = found
    size = dict.fromkeys(order, 1)
    for v in reversed(order):
        if (p := parent[v]) >= 0:
            size[p] += size[v]
    heavy: dict[int, int] = {}
    for v in order:
        p = parent[v]
        if p >= 0 and (p not in heavy or size[v] > size[heavy[p]]):
            heavy[p] = v
    # numbers are handed out from the top: the heavy child's block comes first, the others follow
    pre, chain, pos, above, taken = {root: 0}, {root: root}, {root: 0}, {root: 0}, {}
    rows = []
    for v in order:
        p = parent[v]
        if p >= 0:
            if heavy[p] == v:
                chain[v], pos[v], pre[v] = chain[p], pos[p] + 1, pre[p] + 1
            else:
                at = taken.get(p, pre[p] + 1 + size[heavy[p]])
                taken[p] = at + size[v]
                # the segments above this chain, laid end to end, are as long as the parent is deep, and one more
                chain[v], pos[v], pre[v] = v, 0, at
                above[v] = above[chain[p]] + pos[p] + 1
        rows.append((v, above[chain[v]] + pos[v], p, chain[v], pos[v], pre[v], pre[v] + size[v] - 1))
    return rows


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by group; whole groups at a time."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        done.clear()
        return made

    def solve(grp: str, pairs: set[tuple[int, int]]) -> Iterator[None]:
        ids = sorted({x for p in pairs for x in p}, key=_unsigned)
        at = {x: i for i, x in enumerate(ids)}
        out: list[list[int]] = [[] for _ in ids]
        for u, v in pairs:
            out[at[u]].append(at[v])
        for x in out:
            x.sort()
        group, n_groups = _groups(len(ids), out)
        size, entered, root = [0] * n_groups, [False] * n_groups, [-1] * n_groups
        for v, g in enumerate(group):
            size[g] += 1
            if root[g] < 0:
                root[g] = v
        loops = [False] * len(ids)
        for v, targets in enumerate(out):
            for w in targets:
                if group[v] != group[w]:
                    entered[group[w]] = True
                elif v == w:
                    loops[v] = True
        for g in range(n_groups):
            if entered[g]:
                continue
            for v, depth, up, head, pos, pre, last in heavy_paths(root[g], out):
                done.append((grp, ids[root[g]], ids[v], depth, ids[up] if up >= 0 else None, ids[head], pos, pre, last, int(size[group[v]] > 1 or loops[v])))
            yield

    comp, grp, pairs = None, None, set()
    for b in batches:
        for c, g, u, v in zip(b.column("comp").to_pylist(), b.column("grp").to_pylist(), b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            if c != comp and pairs:
                for _ in solve(grp, pairs):
                    if len(done) >= 20_000:
                        yield flush()
                pairs = set()
            comp, grp = c, g
            pairs.add((u, v))
    if pairs:
        for _ in solve(grp, pairs):
            if len(done) >= 20_000:
                yield flush()
    if done:
        yield flush()


def _min_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color): the least ``ord`` that leads to a node, its own included."""
    state = cut(nodes.select("node", F.col("ord").alias("color"), F.lit(True).alias("moved")))
    while True:
        told = edges.join(state.filter("moved").select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("told"))
        told = state.join(told, "node", "left")
        moved = F.coalesce(F.col("told") < F.col("color"), F.lit(False))
        state = cut(told.select("node", F.when(moved, F.col("told")).otherwise(F.col("color")).alias("color"), moved.alias("moved")), state)
        if state.filter("moved").isEmpty():
            return state.select("node", "color")


def strong_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scc) by forward colouring and backward search; ``scc`` is the least ``ord`` in the group.

    ``nodes`` has (node, ord), ``edges`` (src, dst).  In each round every colour's
    group is split off, so the rounds are few; no group is held in one task.
    """
    left, e, done = cut(nodes.select("node", "ord")), cut(edges.filter("src != dst").select("src", "dst").distinct()), None
    while True:
        # nodes without a way in or without a way out are groups of their own
        core = left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").join(e.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
        core = cut(core)
        alone = left.join(core, "node", "left_anti").select("node", F.col("ord").alias("scc"))
        n_alone = alone.count()
        done = cut(alone if done is None else done.unionByName(alone), *([done] if done is not None else []))
        if core.isEmpty():
            return done
        inside = cut(e.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi"), e)
        left, e = core, inside
        if n_alone:
            continue
        color = _min_reach(left, e)
        same = cut(e.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").filter("cs = cd").select("src", "dst"))
        # backwards from each colour's own node, within the colour
        reached = cut(left.join(color, "node").filter("ord = color").select("node", F.col("color").alias("scc")))
        front = reached
        while not front.isEmpty():
            front = cut(same.join(front.select(F.col("node").alias("dst"), "scc"), "dst").select(F.col("src").alias("node"), "scc").distinct().join(reached, "node", "left_anti"))
            reached = cut(reached.unionByName(front), reached)
        done = cut(done.unionByName(reached), done)
        left = cut(left.join(reached, "node", "left_anti"), left)
        if left.isEmpty():
            return done
        e = cut(e.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"), e)


def distributed_hierarchy(edges: DataFrame) -> DataFrame:
    """The rows of ``hierarchy`` for edges (grp, u, v), by rounds over whole tables."""
    e = cut(edges.select("grp", "u", "v").distinct())
    flip = lambda c: c.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))  # noqa: E731  sorts as unsigned
    nodes = e.select("grp", F.col("u").alias("n")).union(e.select("grp", "v")).distinct()
    nodes = cut(nodes.select(F.struct("grp", F.col("n")).alias("node"), F.struct("grp", flip(F.col("n")).alias("o")).alias("ord")))
    links = cut(e.select(F.struct("grp", F.col("u").alias("n")).alias("src"), F.struct("grp", F.col("v").alias("n")).alias("dst")))
    scc = strong_groups(nodes, links)
    sizes = scc.groupBy("scc").agg(F.count("*").alias("members"))
    cross = links.join(scc.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst")
    entered = cross.filter("a != b").select(F.col("b").alias("scc")).distinct()
    roots = nodes.join(sizes.join(entered, "scc", "left_anti").select(F.col("scc").alias("ord")), "ord", "left_semi").select("node")
    loops = links.filter("src = dst").select(F.col("src").alias("node"), F.lit(1).alias("loop"))
    cyc = cut(scc.join(sizes, "scc").join(loops, "node", "left").select("node", F.when((F.col("members") > 1) | F.col("loop").isNotNull(), 1).otherwise(0).alias("on_cycle")))
    level, depth = cut(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.lit(None).cast("struct<grp:string,n:bigint>").alias("up"))), 0
    seen = level
    while not level.isEmpty():
        depth += 1
        step = links.join(level.select("root", F.col("node").alias("src")), "src").groupBy("root", F.col("dst").alias("node")).agg(F.min_by("src", flip(F.col("src.n"))).alias("up"))
        level = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth"), "up"))
        seen = cut(seen.unionByName(level), seen)
    tree = seen
    # subtree sizes from the deepest level up
    sized = cut(tree.filter(F.col("depth") == depth - 1).withColumn("size", F.lit(1).cast("bigint")))
    done = sized
    for d in range(depth - 2, -1, -1):
        below = sized.groupBy("root", F.col("up").alias("node")).agg(F.sum("size").alias("below"))
        sized = cut(tree.filter(F.col("depth") == d).join(below, ["root", "node"], "left").select("root", "node", "depth", "up", (F.coalesce("below", F.lit(0)) + 1).cast("bigint").alias("size")))
        done = cut(done.unionByName(sized), done) if done is not sized else done
    w = Window.partitionBy("root", "up").orderBy(F.desc("size"), flip(F.col("node.n")))
    ranked = done.withColumn("heavy", (F.row_number().over(w) == 1) & F.col("up").isNotNull()).withColumn("before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut(ranked.withColumn("before", F.coalesce("before", F.lit(0)).cast("bigint")))
    # chain heads by doubling: each heavy node points up its chain until it meets the head
    jump = cut(ranked.select("root", "node", F.when(F.col("heavy"), F.col("up")).otherwise(F.col("node")).alias("head"), F.when(F.col("heavy"), 1).otherwise(0).alias("pos")))
    while True:
        via = jump.select("root", F.col("node").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"))
        nxt = cut(jump.join(via, ["root", "head"]).select("root", "node", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), (F.col("pos2") > 0).alias("moved")))
        more = not nxt.filter("moved").isEmpty()
        jump = nxt.drop("moved")
        if not more:
            break
    # preorder numbers level by level
    base = cut(ranked.join(jump, ["root", "node"]))
    pre = cut(base.filter("depth = 0").select("root", "node", F.lit(0).cast("bigint").alias("pre")))
    numbered = pre
    for d in range(1, depth):
        up = pre.select("root", F.col("node").alias("up"), F.col("pre").alias("p"))
        pre = cut(base.filter(F.col("depth") == d).join(up, ["root", "up"]).select("root", "node", (F.col("p") + 1 + F.col("before")).alias("pre")))
        numbered = cut(numbered.unionByName(pre))
    out = base.join(numbered, ["root", "node"]).join(cyc, "node")
    return out.select(
        F.col("node.grp").alias("grp"), F.col("root.n").alias("root"), F.col("node.n").alias("node"), F.col("depth").cast("int").alias("depth"), F.col("up.n").alias("parent"),
        F.col("head.n").alias("chain"), F.col("pos").cast("int").alias("chain_pos"), "pre", (F.col("pre") + F.col("size") - 1).alias("last"), "on_cycle",
    )


def hierarchy(nodes: DataFrame, edges: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row for each node and each root that leads to it; columns as in ``SCHEMA``.

    ``nodes`` has (grp string, id bigint unique, key bigint unique within grp, compared
    unsigned), ``edges`` (grp, src, dst ids, u, v keys); both ends exist.  Repeated
    edges count once, a self link makes a node cyclic.  ``parent`` is null at a root.
    ``[pre, last]`` is the interval of a node's descendants in its root's tree.  Nodes
    without any link are their own roots.  Empty input gives no rows.
    """
    linked = cut(edges.dropna(subset=["src", "dst"]))
    packed = with_components(linked, ["grp", "u"])
    big = cut(packed.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > local_rows).select("comp"))
    some_big = not big.isEmpty()
    small = packed.join(F.broadcast(big), "comp", "left_anti") if some_big else packed
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = small.select("comp", "grp", "u", "v").repartition(n, "comp").sortWithinPartitions("comp").mapInArrow(_local, SCHEMA)
    if some_big:
        out = out.unionByName(distributed_hierarchy(packed.join(F.broadcast(big), "comp", "left_semi").select("grp", "u", "v")))
    ends = linked.select(F.col("src").alias("id")).union(linked.select("dst"))
    alone = nodes.join(ends, "id", "left_anti").select(
        "grp", F.col("key").alias("root"), F.col("key").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.col("key").alias("chain"), F.lit(0).alias("chain_pos"), F.lit(0).cast("bigint").alias("pre"), F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("on_cycle")
    )
    return out.unionByName(alone)


def chain_segments(rows: DataFrame) -> DataFrame:
    """(grp, root, chain, up, nodes): each chain's nodes in order and the node it hangs from."""
    return rows.groupBy("grp", "root", "chain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chain_pos", "node"))), lambda s: s["node"]).alias("nodes"), F.min_by("parent", "chain_pos").alias("up")
    )


def paths(rows: DataFrame, max_light: int = 64) -> DataFrame:
    """Each row with ``path``, the keys from its root to it: chain segments laid end to end.

    A way has at most log2(nodes) light links, so the loop over chains ends after so
    many rounds (64 at the very most).
    """
    seg = cut(chain_segments(rows))
    at = rows.select("grp", "root", F.col("node").alias("up"), F.col("chain").alias("up_chain"), F.col("chain_pos").alias("up_pos"))
    hung = cut(seg.join(at, ["grp", "root", "up"], "left"))
    front = cut(hung.filter("up is null").select("grp", "root", "chain", F.array().cast("array<bigint>").alias("prefix"), "nodes"))
    known = front
    for _ in range(max_light):
        over = front.select("grp", "root", F.col("chain").alias("up_chain"), F.col("prefix").alias("p"), F.col("nodes").alias("pn"))
        front = cut(hung.join(over, ["grp", "root", "up_chain"]).select("grp", "root", "chain", F.concat("p", F.slice("pn", F.lit(1), F.col("up_pos") + 1)).alias("prefix"), "nodes"))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return rows.join(known.select("grp", "root", "chain", "prefix", "nodes"), ["grp", "root", "chain"]).withColumn("path", F.concat("prefix", F.slice("nodes", F.lit(1), F.col("chain_pos") + 1))).drop("prefix", "nodes")
