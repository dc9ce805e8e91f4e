"""Geometry of incidence tables: which function reads which address.

``reads`` has rows (label, fn, addr, size); repeated rows count once per function and
address.  Addresses are bigint and mean something within a binary only, so ``label`` is
part of every key; clusters are numbered within their binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import entropy_of, ladder
from ..plans.lineage import cut

GAP = 0x1000


#: Columns that tell binaries apart.
BINARY = ["label"]


def populations(reads: DataFrame) -> DataFrame:
    """(label, addr, n_fns, size): functions that read an address, and the greatest size."""
    return reads.groupBy(*BINARY, "addr").agg(F.count_distinct("fn").alias("n_fns"), F.max("size").alias("size"))


def gap_clusters(addresses: DataFrame, gap: int = GAP, by: list[str] | None = None, block_bits: int = 20) -> DataFrame:
    """``addresses`` with ``cluster``, ``base`` and ``offset``: a gap over ``gap`` begins a new cluster.

    Distinct addresses per group in ``by``, by default the binary.  Each group is cut into
    blocks of 2**block_bits addresses, so that a large image is many tasks; clusters that
    touch a block's edge are then joined to those of the next block.
    """
    keys = BINARY if by is None else by
    block = F.shiftright("addr", block_bits)
    a = addresses.select(*keys, "addr").distinct().withColumn("_block", block)
    w = Window.partitionBy(*keys, "_block").orderBy("addr")
    inside = a.withColumn("_new", (F.col("addr") - F.lag("addr").over(w) > gap).cast("int"))
    # the last address of the block before decides whether a block's first one continues it
    ends = a.groupBy(*keys, "_block").agg(F.max("addr").alias("_last"))
    before = ends.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).select(*keys, "_block", "_prev")
    joined = inside.join(before, [*keys, "_block"])
    new = F.coalesce("_new", F.when(F.col("_prev").isNull() | (F.col("addr") - F.col("_prev") > gap), 1).otherwise(0))
    flagged = cut(joined.select(*keys, "addr", "_block", new.alias("_new")))
    per_block = flagged.groupBy(*keys, "_block").agg(F.sum("_new").alias("_k"))
    offset = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = flagged.withColumn("_run", F.sum("_new").over(w)).join(per_block.withColumn("_off", offset).select(*keys, "_block", "_off"), [*keys, "_block"])
    out = numbered.select(*keys, "addr", (F.col("_run") + F.col("_off") - 1).cast("bigint").alias("cluster"))
    base = out.groupBy(*keys, "cluster").agg(F.min("addr").alias("base"))
    return out.join(base, [*keys, "cluster"]).select(*keys, "addr", "cluster", "base", (F.col("addr") - F.col("base")).alias("offset"))


def co_access(reads: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(label, a, b, weight): functions of a binary that read both addresses, a < b.

    With ``near`` (label, addr, cluster) only pairs within a cluster are formed.  Pairs of
    one function are formed in blocks of its addresses: each block of the one side meets
    each block of the other in a task of its own, so a function that reads very many
    addresses is no single task.
    """
    r = reads.select(*BINARY, "fn", "addr").distinct()
    on = [*BINARY, "fn"]
    if near is not None:
        r = r.join(near.select(*BINARY, "addr", "cluster"), [*BINARY, "addr"])
        on = [*on, "cluster"]
    size = r.groupBy(*on).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PAIR_BLOCK)).cast("int").alias("_k"))
    r = r.join(size, on).withColumn("_b", F.pmod(F.xxhash64("addr"), F.col("_k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    left = r.withColumn("_c", every).select(*on, F.col("addr").alias("a"), F.col("_b").alias("_x"), F.col("_c").alias("_y"))
    right = r.withColumn("_c", every).select(*on, F.col("addr").alias("b"), F.col("_c").alias("_x"), F.col("_b").alias("_y"))
    return left.join(right, [*on, "_x", "_y"]).filter("a < b").groupBy(*BINARY, "a", "b").agg(F.count_distinct("fn").alias("weight"))


#: Addresses of a function that meet in one task.
PAIR_BLOCK = 1_000


def hubs(pairs: DataFrame, clusters: DataFrame, top: int = 3) -> DataFrame:
    """(label, cluster, addr, degree, rank): the addresses of each cluster with most co-access."""
    ends = pairs.select(*BINARY, F.explode(F.array("a", "b")).alias("addr"), "weight").groupBy(*BINARY, "addr").agg(F.sum("weight").alias("degree"))
    w = Window.partitionBy(*BINARY, "cluster").orderBy(F.desc("degree"), "addr")
    return ends.join(clusters.select(*BINARY, "addr", "cluster"), [*BINARY, "addr"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*BINARY, "cluster", "addr", "degree", "rank")


def alignment(clusters: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, t3, z, kind): share of offsets that are multiples of four, how far above chance, and what that suggests."""
    a = clusters.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("offset") % 4 == 0).cast("double")).alias("t3"))
    z = (F.col("t3") * F.col("n") - 0.25 * F.col("n")) / F.sqrt(F.col("n") * 0.1875)
    return a.withColumn("z", z).withColumn("kind", ladder((F.col("t3") >= 0.8, "STRUCT"), (F.col("t3") >= 0.4, "ENUM"), otherwise="LOOKUP"))


def access_pattern(density: Column) -> Column:
    return ladder((density < 0.20, "ARRAY"), (density > 0.50, "MONOLITHIC"), otherwise="MIXED")


CLUSTER = [*BINARY, "cluster"]


def co_access_density(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(label, cluster, n, density, pattern): share of a cluster's address pairs that some function reads together."""
    n = clusters.groupBy(*CLUSTER).agg(F.count("*").alias("n"))
    ca, cb = clusters.select(*BINARY, F.col("addr").alias("a"), F.col("cluster").alias("ca")), clusters.select(*BINARY, F.col("addr").alias("b"), F.col("cluster").alias("cb"))
    met = pairs.join(ca, [*BINARY, "a"]).join(cb, [*BINARY, "b"]).filter("ca = cb").groupBy(*BINARY, F.col("ca").alias("cluster")).agg(F.count("*").alias("k"))
    whole = F.col("n") * (F.col("n") - 1) / 2
    out = n.join(met, CLUSTER, "left").withColumn("density", F.when(F.col("n") > 1, F.coalesce("k", F.lit(0)) / whole).otherwise(F.lit(0.0)))
    return out.select(*CLUSTER, "n", "density", access_pattern(F.col("density")).alias("pattern"))


def gaps(clusters: DataFrame) -> DataFrame:
    """(label, cluster, offset, gap): distances between neighbouring offsets."""
    w = Window.partitionBy(*CLUSTER).orderBy("offset")
    return clusters.select(*CLUSTER, "offset").distinct().withColumn("gap", F.col("offset") - F.lag("offset").over(w)).filter("gap is not null")


def gap_entropy(clusters: DataFrame) -> DataFrame:
    """(label, cluster, gap_entropy) in bits."""
    g = gaps(clusters).groupBy(*CLUSTER, "gap").agg(F.count("*").alias("c"))
    n = g.groupBy(*CLUSTER).agg(F.sum("c").alias("n"))
    return g.join(n, CLUSTER).groupBy(*CLUSTER).agg(entropy_of(F.col("c") / F.col("n")).alias("gap_entropy"))


def modal_stride(clusters: DataFrame, least: float = 0.75) -> DataFrame:
    """(label, cluster, stride, share, elements): the gap that divides most gaps; equal shares prefer the smaller; 0 if too few.

    Every distinct gap is tried against the counted gaps of its cluster.
    """
    g = gaps(clusters).filter("gap > 0").groupBy(*CLUSTER, "gap").agg(F.count("*").alias("c"))
    n = g.groupBy(*CLUSTER).agg(F.sum("c").alias("n"))
    span = clusters.groupBy(*CLUSTER).agg(F.max("offset").alias("span"), F.count_distinct(F.when(F.col("offset") > 0, F.col("offset"))).alias("nz"))
    tried = g.select(*CLUSTER, F.col("gap").alias("stride")).join(g, CLUSTER).groupBy(*CLUSTER, "stride").agg(F.sum(F.when(F.col("gap") % F.col("stride") == 0, F.col("c")).otherwise(0)).alias("k")).join(n, CLUSTER)
    best = tried.groupBy(*CLUSTER).agg(F.max_by("stride", F.struct(F.col("k") / F.col("n"), -F.col("stride"))).alias("stride"), F.max(F.col("k") / F.col("n")).alias("share"))
    out = span.join(best, CLUSTER, "left")
    good = (F.col("share") >= least) & (F.col("nz") >= 3)
    return out.select(*CLUSTER, F.when(good, F.col("stride")).otherwise(F.lit(0)).alias("stride"), F.coalesce("share", F.lit(0.0)).alias("share"), F.when(good, F.floor(F.col("span") / F.col("stride")) + 1).otherwise(F.lit(0)).alias("elements"))


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by 94 steps at most, as many as 64-bit numbers can need."""
    start = F.struct(F.greatest(F.abs(a), F.abs(b)).alias("x"), F.least(F.abs(a), F.abs(b)).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(94)), start, step, lambda s: s["x"])


def gcd_stride(clusters: DataFrame, least: int = 4) -> DataFrame:
    """(label, cluster, gcd): greatest common divisor of the offsets of clusters of at least four members, else 0.

    Distinct gaps are folded, few per cluster, not the offsets.
    """
    g = gaps(clusters).groupBy(*CLUSTER).agg(F.count("*").alias("k"), F.array_sort(F.collect_set("gap")).alias("gs"))
    fold = F.aggregate("gs", F.lit(0).cast("bigint"), lambda acc, x: _gcd(acc, x))
    n = clusters.groupBy(*CLUSTER).agg(F.count("*").alias("n"))
    return n.join(g, CLUSTER, "left").select(*CLUSTER, F.when(F.col("n") >= least, F.coalesce(fold, F.lit(0))).otherwise(F.lit(0)).alias("gcd"))


def guard_or_compute(steps: DataFrame, item: str) -> DataFrame:
    """(label, item, median_step, kind) of first steps (label, item, first_step), one a run: within the first three a guard, from the tenth on compute.

    The upper median, from counts of steps.
    """
    c = steps.groupBy(*BINARY, item, "first_step").agg(F.count("*").alias("_c"))
    key = [*BINARY, item]
    n = c.groupBy(*key).agg(F.sum("_c").alias("_n"))
    upto = c.join(n, key).withColumn("_u", F.sum("_c").over(Window.partitionBy(*key).orderBy("first_step")))
    m = upto.filter(F.col("_u") > F.floor(F.col("_n") / 2)).groupBy(*key).agg(F.min("first_step").alias("median_step"))
    return m.withColumn("kind", ladder((F.col("median_step") <= 3, "guard"), (F.col("median_step") >= 10, "compute"), otherwise="neutral"))


def indirect_map(fields: DataFrame) -> DataFrame:
    """(base, offset, size, n_fns) from (fn, base, offset, size)."""
    return fields.groupBy("base", "offset").agg(F.max("size").alias("size"), F.count_distinct("fn").alias("n_fns"))


def power_law_r(counts: DataFrame, by: str) -> DataFrame:
    """(by, n, r): correlation of log rank and log count, by falling count; 0 below five."""
    w = Window.partitionBy(by).orderBy(F.desc("c"), "item")
    ranked = counts.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 5, F.corr(F.log(F.col("_r") + 1.0), F.log(F.greatest(F.col("c"), F.lit(1)).cast("double")))).otherwise(F.lit(0.0)).alias("r"))


# Operators of signed comparisons.
SIGNED = ["SLT", "SLE", "SGT", "SGE", "__slt__", "__sle__", "__sgt__", "__sge__"]


def constraint_type(op: Column, rhs_var: Column, rhs_const: Column) -> Column:
    """The kind of field a constraint hints at; comparisons of two variables are ring buffers."""
    two = rhs_var.isNotNull()
    return ladder(
        ((op == "__eq__") & two, "RING_BUFFER"), ((op == "__eq__") & (rhs_const == 0), "POINTER"), (op == "__eq__", "ENUM"), ((op == "__ne__") & two, "RING_BUFFER"), (op == "__ne__", "EXCLUSION"),
        (op.isin("__lt__", "__le__", "ULT", "ULE") & two, "RING_BUFFER"), (op.isin("__lt__", "__le__", "ULT", "ULE") & (rhs_const != 0), "RANGE"), (op.isin("__gt__", "__ge__", "UGT", "UGE") & two, "RING_BUFFER"),
        (op.isin("__gt__", "__ge__", "UGT", "UGE") & (rhs_const == 0), "SIZE"), (op.isin("__gt__", "__ge__", "UGT", "UGE"), "RANGE"), (op.isin(*SIGNED), "SIGNED"), (op.isin("__and__", "And"), "FLAGS"), (op.isin("__or__", "Or"), "COMPOSITE"),
        otherwise="UNKNOWN",
    )


def dominant_types(constraints: DataFrame) -> DataFrame:
    """(var, n, dominant): a variable's most frequent constraint type but for UNKNOWN; equal counts by name."""
    c = constraints.groupBy("var", "type").agg(F.count("*").alias("c"))
    known = F.when(F.col("type") != "UNKNOWN", F.struct("c", "type"))
    return c.groupBy("var").agg(F.sum("c").alias("n"), F.coalesce(F.max(known)["type"], F.lit("UNKNOWN")).alias("dominant"))


def constant_class(v: Column, low: Column, high: Column) -> Column:
    """What a compared constant is; ``low`` and ``high`` bound the image."""
    return ladder(
        (v == 0, "NULL"), ((v >= low) & (v < high), "DLL_POINTER"), (v < 0, "SIGNED_NEGATIVE_SEMANTIC"), (v > 0x10000000, "HEAP_OR_OS_POINTER"), (v < 0x10000, "SMALL_INT_SEMANTIC"), (v < 0x1000000, "MEDIUM_INT_SEMANTIC"), otherwise="LARGE_UNKNOWN",
    )


#: Signed comparisons that interval logic decides; other operators stand for themselves.
COMPARISONS = ["__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__"]


def implication_classes(formulas: DataFrame) -> DataFrame:
    """(var, kind, bound, n, implied) of distinct formulas (var, op, rhs_const): the classes of equivalent ones, and whether another class implies them.

    A comparison with a constant allows an interval, a point, or all but a point, so it is
    one of: at most a bound (U), at least a bound (L), equal (E), unequal (N).  One of these
    implies another exactly if its set lies within the other's, which the extreme bounds of
    the variable's classes decide without forming pairs.  Other operators imply nothing.
    """
    op, c = F.col("op"), F.col("rhs_const").cast("decimal(20,0)")
    kind = F.when(op.isin("__lt__", "__le__"), "U").when(op.isin("__gt__", "__ge__"), "L").when(op == "__eq__", "E").when(op == "__ne__", "N").otherwise(op)
    bound = F.when(op == "__lt__", c - 1).when(op == "__gt__", c + 1).otherwise(c)
    classes = formulas.filter("var is not null and op is not null and rhs_const is not null").select("var", "op", "rhs_const").distinct().groupBy("var", kind.alias("kind"), bound.alias("bound")).agg(F.count("*").alias("n"))
    of = lambda k: F.when(F.col("kind") == k, F.col("bound"))
    most = classes.groupBy("var").agg(F.min(of("U")).alias("u"), F.max(of("L")).alias("l"), F.min(of("E")).alias("e0"), F.max(of("E")).alias("e1"))
    b, k = F.col("bound"), F.col("kind")
    implied = (
        F.when(k == "U", F.coalesce(F.col("u") < b, F.lit(False)) | F.coalesce(F.col("e0") <= b, F.lit(False)))
        .when(k == "L", F.coalesce(F.col("l") > b, F.lit(False)) | F.coalesce(F.col("e1") >= b, F.lit(False)))
        .when(k == "N", F.coalesce(F.col("u") < b, F.lit(False)) | F.coalesce(F.col("l") > b, F.lit(False)) | F.coalesce((F.col("e0") != b) | (F.col("e1") != b), F.lit(False)))
        .otherwise(F.lit(False))
    )
    return classes.join(most, "var").select("var", "kind", "bound", "n", implied.alias("implied"))


def implication_basis(classes: DataFrame) -> DataFrame:
    """(var, n, n_unique, basis, redundancy): formulas, classes of equivalent ones, and those that no other implies."""
    per = classes.groupBy("var").agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), F.count_if(~F.col("implied")).alias("basis"))
    return per.withColumn("redundancy", 1 - F.col("basis") / F.col("n_unique"))


def change_runs(flags: DataFrame, by: list[str], at: str, tolerance: int = 8) -> DataFrame:
    """(by, start, end, n): runs of positions no more than ``tolerance`` apart."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > tolerance).cast("int"), F.lit(1))
    runs = flags.select(*by, at).distinct().withColumn("_n", new).withColumn("_run", F.sum("_n").over(w))
    return runs.groupBy(*by, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_run")


def pointer_runs(slots: DataFrame, by: list[str], at: str, valid: str, least: int = 3) -> DataFrame:
    """(by, start, n): at least three consecutive positions whose slot is valid."""
    good = slots.filter(F.col(valid)).select(*by, at).distinct()
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return good.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(at).alias("start"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_i")


def walk_until(slots: DataFrame, by: list[str], at: str, value: str, inside: str, misses: int = 3) -> DataFrame:
    """The slots inside the range, up to the first null slot and up to ``misses`` outside in a row."""
    w = Window.partitionBy(*by).orderBy(at)
    out = (~F.col(inside)).cast("int")
    streak = sum((F.coalesce(F.lag(out, i).over(w), F.lit(0)) for i in range(1, misses)), out)
    stop = F.col(value).isNull() | (F.col(value) == 0) | (streak >= misses)
    marked = slots.withColumn("_stop", stop.cast("int"))
    return marked.withColumn("_s", F.coalesce(F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).filter((F.col("_s") == 0) & F.col(inside)).drop("_s", "_stop")
