"""Percentiles per group over very many values, from mergeable value counts.

The state is (group, day, value, n).  It is exact, so a percentile has rank error 0
and value error 0; with ``step`` values are first rounded down to a multiple of it,
which bounds the error of every percentile by ``step`` and the state by the range of
the values.  States of separate partitions or days are added by summing ``n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import range_sorted, with_offsets

#: In thousandths: median, 90th, 95th and 99th percentile.
TARGETS = (500, 900, 950, 990)


def measurements(df: DataFrame, key: str, group: list[str], day: str, value: str) -> DataFrame:
    """(group, day, value) of real measurements, each key once.

    Null, not-a-number, infinite and negative values are no measurements.  Among rows
    with one key the greatest (group, day, value) stands for all.
    """
    v = F.col(value)
    real = df.filter(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")) & F.col(key).isNotNull())
    row = F.struct(*[F.col(c) for c in group], F.col(day).alias("_day"), (v + 0.0).alias("_value"))
    return real.groupBy(key).agg(F.max(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in group], F.col("_r._day").alias("day"), F.col("_r._value").alias("value"))


def value_counts(df: DataFrame, group: list[str], step: float | None = None) -> DataFrame:
    """The mergeable state (group, day, value, n)."""
    value = F.col("value") if step is None else F.floor(F.col("value") / step) * step
    return df.groupBy(*group, "day", value.cast("double").alias("value")).agg(F.count("*").alias("n"))


def merge(*states: DataFrame) -> DataFrame:
    """One state from several with the same columns."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, group: list[str], targets: tuple[int, ...] = TARGETS) -> DataFrame:
    """(group, n, p, value): for each target the least value with at least ceil(n p / 1000) values up to it.

    Value counts are sorted by range; each range's counts follow those before it, and
    only the ranges that hold a target rank are summed row by row.  Null group
    columns form a group of their own.  An empty state gives no rows.
    """
    counts = state.groupBy(*group, "value").agg(F.sum("n").alias("n"))
    ranged = range_sorted(counts, group, ["value"])
    parts, _ = with_offsets(ranged, group, "n")
    wanted = parts.withColumn("p", F.explode(F.array(*[F.lit(t) for t in targets])))
    wanted = wanted.withColumn("_rank", F.floor((F.col("_all") * F.col("p") + 999) / 1000).cast("bigint"))
    wanted = wanted.filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_in")))
    w = Window.partitionBy(*group, "_pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_run", F.sum("n").over(w))
    on = F.col("a._pid") == F.col("b._pid")
    for c in group:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    hit = summed.alias("a").join(wanted.alias("b"), on).filter((F.col("a._run") + F.col("b._before") >= F.col("b._rank")) & (F.col("a._run") - F.col("a.n") + F.col("b._before") < F.col("b._rank")))
    return hit.select(*[F.col(f"a.{c}").alias(c) for c in group], F.col("b._all").cast("bigint").alias("n"), F.col("b.p").alias("p"), F.col("a.value").alias("value"))
