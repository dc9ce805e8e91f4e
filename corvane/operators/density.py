"""Density clusters of vectors: mutual reachability, a spanning tree, and the stablest branches.

Exact for up to ``MAX_POINTS`` points, in one task; more are refused, as another
method would answer another question.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_POINTS = 20_000


def labels_of(x: np.ndarray, min_size: int, min_samples: int) -> np.ndarray:
    """Cluster number of each point, -1 for noise; excess of mass over the condensed tree."""
    n = len(x)
    if n < 2 * min_size:
        return np.full(n, -1)
    sq = (x**2).sum(axis=1)
    core = np.empty(n)
    for a in range(0, n, 1024):
        d = np.sqrt(np.maximum(sq[a : a + 1024, None] + sq[None, :] - 2 * x[a : a + 1024] @ x.T, 0))
        core[a : a + 1024] = np.partition(d, min(min_samples, n - 1), axis=1)[:, min(min_samples, n - 1)]
    # Prim's spanning tree over mutual reachability, row by row
    best, near, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, v = [], 0
    inside[0] = True
    for _ in range(n - 1):
        d = np.sqrt(np.maximum(sq[v] + sq - 2 * x @ x[v], 0))
        d = np.maximum(d, np.maximum(core, core[v]))
        closer = (d < best) & ~inside
        best[closer], near[closer] = d[closer], v
        v = int(np.argmin(np.where(inside, np.inf, best)))
        inside[v] = True
        edges.append((best[v], near[v], v))
    edges.sort()
    # single linkage: node numbers above n are merges
    up, size, kids, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for k, (d, a, b) in enumerate(edges):
        ra, rb, m = find(a), find(b), n + k
        up[ra] = up[rb] = m
        kids[m], size[m], height[m] = (ra, rb), size[ra] + size[rb], d

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            t = todo.pop()
            if t < n:
                out.append(t)
            else:
                todo += kids[t]
        return out

    # condense: only splits into two large parts make new clusters
    clusters: list[dict] = [{"birth": 0.0, "stability": 0.0, "kids": [], "node": 2 * n - 2}]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while node >= n:
            lam = 1 / max(height[node], 1e-12)
            big = [k for k in kids[node] if size[k] >= min_size]
            gone = size[node] if len(big) != 1 else size[node] - size[big[0]]
            clusters[c]["stability"] += gone * (lam - clusters[c]["birth"])
            if len(big) == 2:
                for k in big:
                    clusters.append({"birth": lam, "stability": 0.0, "kids": [], "node": k})
                    clusters[c]["kids"].append(len(clusters) - 1)
                    todo.append((k, len(clusters) - 1))
                break
            if not big:
                break
            node = big[0]
    chosen = set()
    for c in range(len(clusters) - 1, 0, -1):
        below = sum(clusters[k]["stability"] for k in clusters[c]["kids"])
        if clusters[c]["kids"] and below > clusters[c]["stability"]:
            clusters[c]["stability"] = below
        else:
            chosen.add(c)
    out = np.full(n, -1)
    todo2 = list(clusters[0]["kids"])
    number = 0
    while todo2:
        c = todo2.pop(0)
        if c in chosen:
            out[points(clusters[c]["node"])] = number
            number += 1
        else:
            todo2 += clusters[c]["kids"]
    return out


def density_clusters(vectors: DataFrame, key: str, column: str, min_size: int = 200, min_samples: int = 10) -> DataFrame:
    """(key, cluster, method): cluster -1 is noise; null vectors are left out."""
    v = vectors.filter(F.col(column).isNotNull()).select(key, column)
    if v.limit(MAX_POINTS + 1).count() > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} vectors; cluster parts of them, such as binaries, one by one")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array([np.asarray(e, float) for e in pdf[column]])
        return pd.DataFrame({key: pdf[key].to_numpy(), "cluster": labels_of(x, min_size, min_samples), "method": "density"})

    return v.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(solve, f"{key} {dict(v.dtypes)[key]}, cluster int, method string")
