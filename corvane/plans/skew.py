"""Joins whose left side may hold a key with a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hot keys that are broadcast at most; rows / threshold bounds their number.
HOT_KEY_ROWS = 1_000_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: Column,
    how: str = "inner",
    threshold: int = HOT_KEY_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Equi-join where keys with over ``threshold`` left rows are split into ``salts``.

    ``spread`` is a column of ``left`` that differs between rows of one key, so the
    salt is the same when a lost task is computed again.  ``right`` has few rows a
    key; those of hot keys are copied to every salt.  At most rows/threshold keys
    are hot, so the broadcast list of them is bounded.  ``how`` is inner or left.
    Null keys join nothing.
    """
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > threshold).select(*on, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)
    salted = left.withColumn("_spread", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(hot, on, "left")
    salted = salted.withColumn("_salt", F.when(F.col("_hot"), F.col("_spread")).otherwise(F.lit(0))).drop("_hot", "_spread")
    copies = right.join(hot, on, "left")
    copies = copies.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
