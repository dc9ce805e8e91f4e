"""Pairs of texts whose sets of word runs are similar, by vertical partitioning.

All word runs (n-grams) are put into one global order, rarest first.  The order is
cut into fragments, so that a text's runs become one segment per fragment; texts
are also split by size, as similar texts have similar sizes.  A pair is a candidate
if its rarest runs meet (no pair that is similar enough can avoid that).  Overlaps
of candidates are counted in each fragment separately and summed per pair.

A run found in one text only can't be part of an overlap.  A Bloom filter of the
others, of bounded size, drops it before runs are shuffled, and with it every text
that keeps too few runs to be similar to any other; what the filter lets pass
wrongly is dropped by the exact counts that follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import bloom
from ..plans.lineage import cut

TOKEN = r"[A-Za-z0-9_]+"
#: Fragments of the global order.
FRAGMENTS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: DataFrame, key: str, text: str, n: int, least: int, token: str = TOKEN) -> DataFrame:
    """(key, size, runs, sig_a, sig_b): the distinct hashed runs of n tokens of each text of at least ``least`` tokens.

    Whole texts; ``sig_a`` and ``sig_b`` are equal for equal sets of runs.  Null
    texts and texts of fewer tokens give no row.
    """
    kind = dict(texts.dtypes)[key]
    least = max(least, n)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(token).findall
        known: dict[str, int] = {}
        for batch in batches:
            keys, words, ends = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is None or k is None:
                    continue
                found = find(t)
                if len(found) < least:
                    continue
                keys.append(k)
                for w in found:
                    h = known.get(w)
                    if h is None:
                        if len(known) > 500_000:
                            known.clear()
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    words.append(h)
                ends.append(len(words))
            if not keys:
                continue
            h = np.array(words, np.uint64)
            run = h[: len(h) - n + 1].copy()
            for i in range(1, n):
                run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
            lists, sizes, a, b, begin = [], [], [], [], 0
            for end in ends:
                own = np.unique(run[begin : end - n + 1])
                lists.append(own)
                sizes.append(len(own))
                with np.errstate(over="ignore"):
                    a.append(int(_mix(own).sum(dtype=np.uint64)))
                    b.append(int(_mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                begin = end
            flat = np.concatenate(lists).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))],
                ["key", "size", "runs", "sig_a", "sig_b"],
            )

    return texts.select(key, text).mapInArrow(make, f"key {kind}, size int, runs array<bigint>, sig_a bigint, sig_b bigint")


def _enough(part: str, threshold: float) -> Column:
    return F.col(part) >= F.ceil(F.col("size") * threshold - 1e-9)


def similar_sets(sets: DataFrame, threshold: float, fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and the similar pairs of classes, from ``runs``.

    Returns members (key, rep) and pairs (a, b, overlap, similarity), a < b, of the
    representatives, the least keys of their classes.  Members list only texts that
    may have a partner; any other text is similar to none.
    """
    occurrences = sets.select(F.explode("runs").alias("run"))
    shared = cut(occurrences.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1").select("run"))
    filter_ = bloom.build(shared, ["run"], shared.count())
    # only runs that some other text has, and only texts that keep enough of them
    kept = bloom.probe(sets.select("key", "size", "sig_a", "sig_b", F.explode("runs").alias("run")), ["run"], filter_, "_maybe").filter("_maybe")
    kept = kept.groupBy("key").agg(F.first("size").alias("size"), F.first("sig_a").alias("sig_a"), F.first("sig_b").alias("sig_b"), F.collect_list("run").alias("runs"))
    kept = cut(kept.withColumn("_n", F.size("runs")).filter(_enough("_n", threshold)).drop("_n"), shared)
    members = kept.groupBy("sig_a", "sig_b", "size").agg(F.min("key").alias("rep"))
    members = cut(kept.select("key", "sig_a", "sig_b", "size").join(members, ["sig_a", "sig_b", "size"]).select("key", "rep"))
    one = kept.join(members.filter("key = rep").select("key"), "key", "left_semi").select("key", "size", F.explode("runs").alias("run"))
    # exact counts among what is left; runs of a single class fall out, and classes with too few
    often = one.groupBy("run").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = cut(one.join(often, "run"))
    cuts = ranked.select(F.col("df")).stat.approxQuantile("df", [i / fragments for i in range(1, fragments)], 0.01) if fragments > 1 else []
    cuts = sorted(set(cuts))
    fragment = F.lit(0)
    for c in cuts:
        fragment = fragment + (F.col("df") > c).cast("int")
    bucket = F.floor(F.log(F.col("size").cast("double")) / F.lit(-log(threshold)) + 1e-9)
    texts = ranked.groupBy("key").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("df", "run", fragment.alias("f")))).alias("order"))
    texts = texts.withColumn("_n", F.size("order")).filter(_enough("_n", threshold)).withColumn("bucket", bucket.cast("int"))
    texts = cut(texts, ranked)
    # a similar pair shares ceil(t size) runs of either text, so it meets in the first size - ceil(t size) + 1;
    # the size - _n runs of one text only come first in the order
    prefix = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1 - (F.col("size") - F.col("_n"))
    heads = texts.select("key", "size", "bucket", F.explode(F.slice("order", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))).alias("o")).select("key", "size", "bucket", F.col("o.run").alias("run"))
    left = heads.select(F.col("key").alias("a"), F.col("size").alias("size_a"), "run", "bucket")
    right = heads.select(F.col("key").alias("b"), F.col("size").alias("size_b"), "run", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    # b is the shorter text, or of equal size the one with the greater key; its bucket is that of a or the one below
    met = left.join(right, ["run", "bucket"]).filter(
        (F.col("size_b") >= F.col("size_a") * threshold - 1e-9) & ((F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("a") < F.col("b"))))
    )
    candidates = cut(met.select("a", "b", "size_a", "size_b").distinct())
    segments = texts.select("key", F.explode("order").alias("o")).groupBy("key", F.col("o.f").alias("f")).agg(F.collect_list("o.run").alias("segment"))
    segments = cut(segments, texts)
    part = (
        candidates.join(segments.select(F.col("key").alias("a"), "f", F.col("segment").alias("sa")), "a")
        .join(segments.select(F.col("key").alias("b"), "f", F.col("segment").alias("sb")), ["b", "f"])
        .select("a", "b", "size_a", "size_b", F.size(F.array_intersect("sa", "sb")).alias("part"))
    )
    total = part.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").alias("overlap"))
    similarity = F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))
    pairs = total.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold - 1e-12)
    return members, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap", "similarity")


def near_duplicates(texts: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, least: int = 5, token: str = TOKEN) -> tuple[DataFrame, DataFrame]:
    """``similar_sets`` of the runs of a text column; keys are unique and not null."""
    return similar_sets(runs(texts, key, text, n, least, token), threshold)


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of single texts: every pair within a class and across similar classes.

    As many rows as the result asks for; of a large class of copies that is the square of it.
    """
    m = cut(members)
    left, right = m.select(F.col("key").alias("x"), F.col("rep").alias("a")), m.select(F.col("key").alias("y"), F.col("rep").alias("b"))
    across = pairs.join(left, "a").join(right, "b").select("x", "y", "similarity")
    several = m.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep")
    copies = m.join(several, "rep", "left_semi")
    within = copies.select(F.col("key").alias("x"), "rep").join(copies.select(F.col("key").alias("y"), "rep"), "rep").filter("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    out = across.unionByName(within)
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
