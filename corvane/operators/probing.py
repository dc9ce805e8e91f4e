"""Plans for probing functions, verdicts on what came back, and quality guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ladder, upper_median


def budget(degree: Column) -> Column:
    """Probes for a polynomial degree; an unknown one (-1) gets the most."""
    return F.when(degree < 0, 2048).when(degree <= 1, 64).when(degree == 2, 256).when(degree <= 5, 512).otherwise(2048)


def shape_verdict(n_in: Column, n_out: Column) -> Column:
    return ladder((n_out <= 1, "constant"), (n_out <= 3, "few"), (n_out > 0.8 * n_in, "mixing"), otherwise="structured")


def escalate(avalanche: Column, entropy: Column, sentinel: Column) -> Column:
    """Whether the metrics leave a function undecided."""
    return F.greatest(avalanche, entropy, sentinel) - 0.5 < 0.30


def replayed(calls: DataFrame) -> DataFrame:
    """(func, x, n, mode, mode_share, divergent) of repeated calls (func, x, fx): is the result a function of the input?"""
    c = calls.groupBy("func", "x", "fx").agg(F.count("*").alias("c"))
    g = c.groupBy("func", "x").agg(F.sum("c").alias("n"), F.max_by("fx", F.struct("c", -F.col("fx").cast("decimal(20,0)"))).alias("mode"), (F.max("c") / F.sum("c")).alias("mode_share"))
    return g.withColumn("divergent", F.col("mode_share") < 1)


def return_width(values: DataFrame) -> DataFrame:
    """(func, bits, signed): the width that holds every result, and whether over a tenth are negative."""
    size = F.when(F.col("fx") < 0, -(F.col("fx") + 1)).otherwise(F.col("fx"))
    g = values.groupBy("func").agg(F.max(size).alias("m"), F.avg((F.col("fx") < 0).cast("double")).alias("neg"))
    bits = F.when(F.col("m") <= 1, 1).when(F.col("m") < 1 << 8, 8).when(F.col("m") < 1 << 16, 16).when(F.col("m") < 1 << 32, 32).otherwise(64)
    return g.select("func", bits.alias("bits"), (F.col("neg") > 0.1).alias("signed"))


# The four signs and the rule of signs for products and sums.
SIGNS = ["POS", "NEG", "ZERO", "ANY"]


def sign_product(a: Column, b: Column) -> Column:
    return F.when((a == "ZERO") | (b == "ZERO"), "ZERO").when((a == "ANY") | (b == "ANY"), "ANY").when(a == b, "POS").otherwise("NEG")


def sign_sum(a: Column, b: Column) -> Column:
    return F.when(a == "ZERO", b).when(b == "ZERO", a).when((a == b) & (a != "ANY"), a).otherwise("ANY")


def sweep(spark: SparkSession, n: int, landmarks: list[int]) -> DataFrame:
    """(x): 0..n-1 and the landmarks, each once."""
    marks = spark.createDataFrame([(x,) for x in landmarks], "x bigint")
    return spark.range(n).select(F.col("id").alias("x")).union(marks).distinct()


def arguments(value: Column, n: int) -> Column:
    return F.concat(F.array(value), F.array_repeat(F.lit(0).cast("bigint"), max(n - 1, 0)))


def gridded(points: DataFrame, x: str, y: str, width: int, height: int) -> DataFrame:
    """``points`` with grid cells (cx, cy): both ranges cut evenly, the greatest value in the last cell."""
    lim = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda v, a, b, k: F.when(F.col(b) > F.col(a), F.least(F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * k), F.lit(k - 1))).otherwise(F.lit(0))
    return points.join(F.broadcast(lim)).withColumn("cx", cell(x, "x0", "x1", width)).withColumn("cy", cell(y, "y0", "y1", height)).drop("x0", "x1", "y0", "y1")


def word_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(word,): aligned 8-byte words in which two snapshots (pos, byte) differ."""
    both = before.select("pos", F.col("byte").alias("b")).join(after.select("pos", F.col("byte").alias("a")), "pos", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.floor(F.col("pos") / 8).alias("word")).distinct()


def calibrated(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, value, source): stored thresholds over the defaults; unknown names are left out."""
    s = stored.groupBy("name").agg(F.max("value").alias("_v"))
    return defaults.join(s, "name", "left").select("name", F.coalesce("_v", "value").alias("value"), F.when(F.col("_v").isNotNull(), "stored").otherwise("default").alias("source"))


def guards(reports: DataFrame) -> DataFrame:
    """(key, rule, severity): data-quality rules that a report breaks; columns n_globals, n_fns, n_clusters, n_constraints."""
    c = F.col
    rules = [
        ("no functions", "ERROR", c("n_fns") <= 0), ("no globals", "ERROR", c("n_globals") <= 0), ("globals without clusters", "WARN", (c("n_globals") > 0) & (c("n_clusters") == 0)),
        ("one function only", "WARN", c("n_fns") == 1), ("more clusters than globals", "WARN", c("n_clusters") > c("n_globals")), ("reads without constraints", "INFO", (c("n_globals") > 0) & (c("n_constraints") == 0)),
    ]
    broken = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, cond in rules]))
    return reports.select("key", F.explode(broken).alias("i")).select("key", "i.rule", "i.severity")


def slow_timings(timings: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, p95, greatest): upper median and element floor(n 0.95) of finite times, from value counts."""
    v = F.col(value)
    kept = timings.filter(v.isNotNull() & ~F.isnan(v) & (v >= 0)).groupBy(by, value).agg(F.count("*").alias("c"))
    from pyspark.sql.window import Window

    n = kept.groupBy(by).agg(F.sum("c").alias("n"))
    cum = kept.join(n, by).withColumn("_u", F.sum("c").over(Window.partitionBy(by).orderBy(value)))
    at = lambda q: F.min(F.when(F.col("_u") > F.least(F.floor(F.col("n") * q / 100), F.col("n") - 1), v))
    return cum.groupBy(by).agg(F.max("n").alias("n"), at(50).alias("median"), at(95).alias("p95"), F.max(v).alias("greatest"))


def candidate_pairs(values: DataFrame, group: str, partner: Column) -> DataFrame:
    """(group, a, b) of unequal values of one group where b is the ``partner`` of a, an expression over the column value.

    The oracle of a pair is such a relation, so pairs are looked up by hash and never formed
    all with all; a null partner has none.
    """
    v = values.select(group, "value").dropna().distinct()
    left = v.select(group, F.col("value").alias("a"), partner.alias("b"))
    return left.join(v.withColumnRenamed("value", "b"), [group, "b"]).filter("a != b").select(group, "a", "b")


def status_rollup(items: DataFrame) -> DataFrame:
    """One row (n, named, errors, mean_score, median_score) of items (name, error, score)."""
    return items.agg(F.count("*").alias("n"), F.count("name").alias("named"), F.count("error").alias("errors"), F.avg("score").alias("mean_score"), upper_median(F.col("score")).alias("median_score"))
