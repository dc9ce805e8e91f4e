"""The tables of a data folder, and the relations the operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import address


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order``; rows equal in it are copies.

    One partial aggregation; among equal times the greatest row wins, so the result
    does not depend on the order of the rows.  A null ``order`` is the earliest.
    """
    row = F.struct(F.col(order), *[F.col(c) for c in columns if c != order])
    return df.groupBy(*key).agg(F.max(row).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def current_functions(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """(fn_id, columns) of the current row of each function."""
    return latest(table(spark, folder, "calltree"), ["fn_id"], "dump_ts", columns)


def call_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (grp, id, key) and edges (grp, src, dst, u, v) of the calls within a binary, from current rows."""
    now = current_functions(spark, folder, ["label", "va", "called_vas"]).select(F.col("label").alias("grp"), F.col("fn_id").alias("id"), address(F.col("va")).alias("key"), "called_vas")
    nodes = now.select("grp", "id", "key").dropna()
    calls = now.select("grp", F.col("id").alias("src"), F.col("key").alias("u"), F.explode("called_vas").alias("target"))
    calls = calls.select("grp", "src", "u", address(F.col("target")).alias("v")).dropna().distinct()
    edges = calls.join(nodes.select("grp", F.col("id").alias("dst"), F.col("key").alias("v")), ["grp", "v"])
    return nodes, edges.select("grp", "src", "dst", "u", "v")


def day_of(ts: Column) -> Column:
    return F.to_date(ts)
