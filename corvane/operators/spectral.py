"""Ranks and spectra of incidence matrices.

A matrix has rows (matrix, row_id, col_id), distinct.  One matrix is one group: the
kernels need it whole, so a matrix of more than ``MAX_CELLS`` entries is refused
rather than thinned out; the Gram products that feed the spectra are distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_CELLS = 5_000_000


def _guard(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("matrix").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if n is not None and n > MAX_CELLS:
        raise ValueError(f"a matrix has {n} entries; at most {MAX_CELLS} are handled")
    return cells


def gf2_staircase(cells: DataFrame) -> DataFrame:
    """(matrix, pos, row_id, rank): rank over GF(2) of the rows up to each, in the order of row_id."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = {c: i for i, c in enumerate(sorted(pdf["col_id"].unique()))}
        basis: dict[int, int] = {}
        out = []
        for pos, (row, part) in enumerate(pdf.sort_values("row_id").groupby("row_id", sort=True)):
            v = 0
            for c in part["col_id"]:
                v |= 1 << columns[c]
            while v:
                top = v.bit_length() - 1
                if top not in basis:
                    basis[top] = v
                    break
                v ^= basis[top]
            out.append((pdf["matrix"].iloc[0], pos, row, len(basis)))
        return pd.DataFrame(out, columns=["matrix", "pos", "row_id", "rank"])

    kinds = dict(cells.dtypes)
    return _guard(cells.distinct()).groupBy("matrix").applyInPandas(fold, f"matrix {kinds['matrix']}, pos int, row_id {kinds['row_id']}, rank int")


def gf2_rank(cells: DataFrame) -> DataFrame:
    """(matrix, n_rows, rank, redundancy)."""
    s = gf2_staircase(cells).groupBy("matrix").agg(F.count("*").alias("n_rows"), F.max("rank").alias("rank"))
    return s.withColumn("redundancy", 1 - F.col("rank") / F.col("n_rows"))


def redundancy_band(r):
    return F.when(r > 0.10, "HIGH").when(r > 0.02, "MED").otherwise("LOW")


def jump_density(stairs: DataFrame) -> DataFrame:
    """(matrix, early, late, ratio): share of rows that raise the rank in the first and the last third."""
    w = Window.partitionBy("matrix").orderBy("pos")
    j = stairs.withColumn("jump", (F.col("rank") > F.coalesce(F.lag("rank").over(w), F.lit(0))).cast("double"))
    n = stairs.groupBy("matrix").agg(F.count("*").alias("n"))
    third = F.col("n") / 3
    g = j.join(n, "matrix").groupBy("matrix").agg(F.avg(F.when(F.col("pos") < third, F.col("jump"))).alias("early"), F.avg(F.when(F.col("pos") >= 2 * third, F.col("jump"))).alias("late"))
    return g.withColumn("ratio", F.when(F.col("early") > 0, F.col("late") / F.col("early")).otherwise(F.lit(0.0)))


def singular_values(cells: DataFrame, k: int | None = 30) -> DataFrame:
    """(matrix, i, sigma, gap, mp_upper, over): largest singular values of each 0/1 matrix, or all with ``k`` None.

    Values within rounding of 0 are 0.
    ``gap`` is 1 - sigma2/sigma1; ``mp_upper`` the edge that chance would give the
    eigenvalues of the centred, scaled matrix; ``over`` how far the value is above it.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pd.factorize(pdf["row_id"], sort=True)[0], pd.factorize(pdf["col_id"], sort=True)[0]
        m = np.zeros((rows.max() + 1, cols.max() + 1))
        m[rows, cols] = 1
        small = m @ m.T if m.shape[0] <= m.shape[1] else m.T @ m
        values = np.linalg.eigvalsh(small)[::-1]
        sigma = np.sqrt(np.where(values > values[0] * len(values) * np.finfo(float).eps, values, 0))[:k]
        gamma = min(m.shape) / max(m.shape)
        upper = m.var() * max(m.shape) * (1 + gamma**0.5) ** 2
        gap = 1 - sigma[1] / sigma[0] if len(sigma) > 1 and sigma[0] > 0 else 1.0
        return pd.DataFrame({"matrix": pdf["matrix"].iloc[0], "i": np.arange(len(sigma)), "sigma": sigma, "gap": gap, "mp_upper": upper, "over": sigma**2 / max(upper, 1e-12)})

    kind = dict(cells.dtypes)["matrix"]
    return _guard(cells.distinct()).groupBy("matrix").applyInPandas(solve, f"matrix {kind}, i int, sigma double, gap double, mp_upper double, over double")


def leverage(cells: DataFrame, cut_at: float = 0.5) -> DataFrame:
    """(matrix, row_id, leverage): row norms of the left singular vectors whose values exceed ``cut_at``."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, names = pd.factorize(pdf["row_id"], sort=True)
        cols = pd.factorize(pdf["col_id"], sort=True)[0]
        m = np.zeros((rows.max() + 1, cols.max() + 1))
        m[rows, cols] = 1
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        return pd.DataFrame({"matrix": pdf["matrix"].iloc[0], "row_id": names, "leverage": (u[:, s > cut_at] ** 2).sum(axis=1)})

    kinds = dict(cells.dtypes)
    return _guard(cells.distinct()).groupBy("matrix").applyInPandas(solve, f"matrix {kinds['matrix']}, row_id {kinds['row_id']}, leverage double")


def fiedler(pairs: DataFrame) -> DataFrame:
    """(matrix, n, fiedler): second least eigenvalue of the normalised Laplacian of a weighted graph (matrix, a, b, weight)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {x: i for i, x in enumerate(sorted(set(pdf["a"]) | set(pdf["b"])))}
        m = np.zeros((len(names), len(names)))
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"], strict=True):
            m[names[a], names[b]] = m[names[b], names[a]] = w
        d = 1 / np.sqrt(np.maximum(m.sum(axis=1), 1e-12))
        values = np.linalg.eigvalsh(np.eye(len(m)) - d[:, None] * m * d[None, :])
        return pd.DataFrame({"matrix": [pdf["matrix"].iloc[0]], "n": [len(m)], "fiedler": [float(values[1]) if len(values) > 1 else 0.0]})

    kind = dict(pairs.dtypes)["matrix"]
    return pairs.groupBy("matrix").applyInPandas(solve, f"matrix {kind}, n int, fiedler double")


def gram(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(i, j, g): sums of products of the components of all vectors; distributed, as large as the dimension squared."""

    def part(batches):
        total = None
        for b in batches:
            m = np.array([np.asarray(x, float) for x in b[column] if x is not None])
            if len(m):
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    return vectors.select(column).mapInPandas(part, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def truncated_svd(vectors: DataFrame, k: int = 30, column: str = "embedding") -> DataFrame:
    """(i, sigma): singular values of the matrix whose rows are the vectors, from their Gram matrix."""
    spark = vectors.sparkSession
    rows = gram(vectors, column).collect()  # the dimension squared, whatever the number of vectors
    size = max((r["i"] for r in rows), default=-1) + 1
    m = np.zeros((size, size))
    for r in rows:
        m[r["i"], r["j"]] = r["g"]
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(m)[::-1], 0))[:k] if size else []
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, sigma double")


def spacings(values: DataFrame, by: str = "matrix") -> DataFrame:
    """(by, i, spacing): neighbouring eigenvalue distances over their local mean."""
    w = Window.partitionBy(by).orderBy(F.desc("sigma"))
    n = Window.partitionBy(by)
    s = values.withColumn("_s", F.col("sigma") - F.lead("sigma").over(w)).filter("_s is not null")
    local = F.avg("_s").over(w.rowsBetween(-3, 3))
    return s.withColumn("i", F.row_number().over(w) - 1).withColumn("spacing", F.when(local > 0, F.col("_s") / local).otherwise(F.lit(0.0))).withColumn("n", F.count("*").over(n)).select(by, "i", "spacing", "n")


def brody(spacing: DataFrame, by: str = "matrix") -> DataFrame:
    """(by, beta, ks): the Brody exponent in [0.01, 1.2] that fits the spacings best; equal values have no spacing, and null is the exponent of none."""
    from math import gamma

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sort(pdf["spacing"].to_numpy())
        s = s[s > 1e-9]
        if not len(s):
            return pd.DataFrame({by: [pdf[by].iloc[0]], "beta": [None], "ks": [None]})
        e = (np.arange(len(s)) + 1) / len(s)
        best = min(((np.abs(1 - np.exp(-(gamma((b + 2) / (b + 1)) ** (b + 1)) * s ** (b + 1)) - e)).max(), b) for b in np.linspace(0.01, 1.2, 120))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "beta": [best[1]], "ks": [best[0]]})

    return spacing.groupBy(by).applyInPandas(fit, f"{by} {dict(spacing.dtypes)[by]}, beta double, ks double")


def bootstrap(items: DataFrame, value: str, sizes: list[int], reps: int = 20, seed: int = 0) -> DataFrame:
    """(size, n_reps, mean, sd, cv, status): means of samples without replacement, by a hash order of each repetition."""
    r = items.select("id", value).crossJoin(F.broadcast(items.sparkSession.range(reps).withColumnRenamed("id", "rep")))
    ranked = r.withColumn("_k", F.row_number().over(Window.partitionBy("rep").orderBy(F.xxhash64(F.lit(seed), "rep", "id"), "id")))
    ranked = ranked.filter(F.col("_k") <= max(sizes))  # known before the exchange, so tasks pass on no more than this
    grid = ranked.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter("_k <= size")
    each = grid.groupBy("size", "rep").agg(F.avg(value).alias("m"))
    out = each.groupBy("size").agg(F.count("*").alias("n_reps"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    cv = F.when(F.col("mean") != 0, 100 * F.col("sd") / F.abs("mean"))
    return out.withColumn("cv", cv).withColumn("status", F.when(cv < 10, "CONVERGED").when(cv < 25, "NEAR").otherwise("UNSTABLE"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """(n, groups, h): Kruskal-Wallis statistic from average ranks, which come from the counts of distinct values."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = hist.withColumn("rank", before + (F.col("c") + 1) / 2).select(value, "rank")
    g = df.join(ranks, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    n = F.sum("k")
    return g.agg(n.alias("n"), F.count("*").alias("groups"), (12 / (n * (n + 1)) * F.sum(F.col("r") ** 2 / F.col("k")) - 3 * (n + 1)).alias("h"))
