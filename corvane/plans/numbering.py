"""Consecutive numbers in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the order given, which should have no ties.

    Rows are ranged, numbered within each range, and moved up by the sizes of the
    ranges before; only these sizes, one per range, are summed in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_range", before.alias("_before")))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return own.join(offsets, "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")
