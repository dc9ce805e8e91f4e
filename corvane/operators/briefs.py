"""Briefs: what stands out in a cluster, a group of labels or a binary, as bounded top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .patterns import top_per_group


def cluster_name(cluster: Column, names: dict[int, str]) -> Column:
    """The archetype of a cluster number: NOISE for -1, C and the number for an unnamed one; null stays null."""
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]) if names else F.create_map().cast("map<int,string>")
    return F.when(cluster == -1, "NOISE").otherwise(F.coalesce(known[cluster], F.concat(F.lit("C"), cluster.cast("string"))))


def cluster_profile(members: DataFrame, present: DataFrame, cluster: str, binaries: int = 5, rules: int = 5, examples: int = 3) -> DataFrame:
    """(cluster, kind, rank, item, value) of members (cluster, label, fn_id) and rules present (fn_id, rule_id).

    ``size`` is the number of members, ``binary`` the labels with most of them, ``rule`` the
    rules whose share within the cluster exceeds that overall most, ``example`` the least ids.
    Members and rules present are merged: neither is small enough to broadcast, whatever the
    size of its file.  They meet once; the counts overall are sums of those by cluster.
    """
    text = lambda c: F.col(c).cast("string")
    n = members.groupBy(cluster).agg(F.count("*").alias("_n"))
    size = n.select(cluster, F.lit("size").alias("kind"), F.lit(1).alias("rank"), F.lit("n").alias("item"), F.col("_n").cast("double").alias("value"))
    by = members.groupBy(cluster, "label").agg(F.count("*").alias("value"))
    by = top_per_group(by, [cluster], [F.desc("value"), F.col("label")], binaries).select(cluster, F.lit("binary").alias("kind"), "rank", F.col("label").alias("item"), F.col("value").cast("double").alias("value"))
    total = F.broadcast(members.agg(F.count("*").alias("_all")))
    own = present.select("fn_id", "rule_id").join(members.select("fn_id", cluster).hint("merge"), "fn_id")
    held = own.filter("rule_id is not null").groupBy(cluster, "rule_id").agg(F.count("*").alias("_c"))
    overall = F.sum("_c").over(Window.partitionBy("rule_id")) / F.col("_all")
    lift = held.join(total).withColumn("_o", overall).join(n, cluster).select(cluster, "rule_id", F.round(F.col("_c") / F.col("_n") - F.col("_o"), 6).alias("value"))
    lift = top_per_group(lift, [cluster], [F.desc("value"), F.col("rule_id")], rules).select(cluster, F.lit("rule").alias("kind"), "rank", text("rule_id").alias("item"), "value")
    first = top_per_group(members, [cluster], [F.col("fn_id")], examples).select(cluster, F.lit("example").alias("kind"), "rank", text("fn_id").alias("item"), F.lit(None).cast("double").alias("value"))
    return size.unionByName(by).unionByName(lift).unionByName(first)


def group_analysis(labels: DataFrame, edges: DataFrame, group: str, own: str, least: int = 100, top: int = 4) -> DataFrame:
    """(group, n, modal, rank, callee, share): of groups of at least ``least`` nodes, the most frequent own label and the labels called most.

    ``labels`` has (node, group, own); calls that leave the nodes count as EXTERNAL.  Equal
    counts by label; a group that calls nothing has one row with a null callee.
    """
    n = labels.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    modal = labels.groupBy(group, own).agg(F.count("*").alias("_c")).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_c"), own))).filter("_r = 1").select(group, F.col(own).alias("modal"))
    mine = labels.select(F.col("node").alias("src"), group).join(n, group)
    called = edges.join(mine, "src").join(labels.select(F.col("node").alias("dst"), F.col(own).alias("callee")), "dst", "left").select(group, F.coalesce("callee", F.lit("EXTERNAL")).alias("callee"))
    c = called.groupBy(group, "callee").agg(F.count("*").alias("_k"))
    share = c.withColumn("share", F.col("_k") / F.sum("_k").over(Window.partitionBy(group)))
    best = top_per_group(share, [group], [F.desc("_k"), F.col("callee")], top).select(group, "rank", "callee", "share")
    return n.join(modal, group).join(best, group, "left").select(group, "n", "modal", "rank", "callee", "share")


def bands(rows: DataFrame, by: list[str], band: str, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """The first rows of each band, as many as ``limits`` gives it; a compact packet."""
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy(*by, band).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most[F.col(band)])


def comparison(values: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(metric, lowest, highest, spread, at_lowest, at_highest): how far binaries are apart in each metric; equal values by name."""
    long = values.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(by, "m.metric", "m.v").filter("v is not null")
    g = long.groupBy("metric").agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.min(F.struct("v", by))[by].alias("at_lowest"), F.min(F.struct((-F.col("v")).alias("v"), F.col(by)))[by].alias("at_highest"))
    return g.select("metric", "lowest", "highest", (F.col("highest") - F.col("lowest")).alias("spread"), "at_lowest", "at_highest")
