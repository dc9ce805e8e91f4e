"""Enough tasks for costly work per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` hashed by ``key`` over all cores where its scan has fewer tasks than cores; else as it is.

    A small file is one task however much each of its rows costs.  For scans only: asking
    for the number of tasks would run the exchanges of a plan that has some.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
