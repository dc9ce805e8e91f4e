"""Running sums over a globally sorted table, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut


def range_sorted(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` ranged by (group, order), written with ``_pid``, the number of its range.

    A large group spans several ranges; small ones share one.  The table is written
    so that the ranges stay the same when a task is computed again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))


def with_offsets(ranged: DataFrame, group: list[str], weight: str) -> tuple[DataFrame, DataFrame]:
    """(group, _pid, _before, _in, _all): the weight before and in each range of a group, and the whole; and (group, _all)."""
    parts = ranged.groupBy(*group, "_pid").agg(F.sum(weight).alias("_in"))
    # as many rows as groups and ranges together, whatever the number of rows
    w = Window.partitionBy(*group).orderBy("_pid")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn("_all", F.sum("_in").over(Window.partitionBy(*group)))
    return parts, parts.groupBy(*group).agg(F.max("_all").alias("_all"))


def running(ranged: DataFrame, parts: DataFrame, group: list[str], order: list[str], weight: str) -> DataFrame:
    """``ranged`` joined with ``parts``, with ``_cum``: the weight up to and with each row of its group."""
    w = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group] + [F.col("a._pid") == F.col("b._pid")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = ranged.withColumn("_run", F.sum(weight).over(w)).alias("a").join(parts.alias("b"), on)
    return joined.select("a.*", "b._before", "b._in", "b._all").withColumn("_cum", F.col("_before") + F.col("_run"))
