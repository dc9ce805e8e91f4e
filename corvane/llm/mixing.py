"""Mixtures of sources with target shares of the tokens and capped repeats."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from math import exp, floor, inf, isfinite, log

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.spread import spread
from .ranges import range_sorted, running, with_offsets

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Rows of (plan, source) targets that the driver handles at most.
MAX_TARGETS = 100_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(texts: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep, tokens): the number of tokens of each whole text; null texts have 0."""
    kinds = dict(texts.dtypes)
    # shipped to the executors, which need not have the file
    texts.sparkSession.sparkContext.addFile(vocabulary)
    shipped = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(SparkFiles.get(shipped)).encode_ordinary
        for batch in batches:
            sizes = [0 if t is None else len(encode(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, "tokens"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", tokens bigint"
    return spread(texts.select(*keep, text), keep[0]).mapInArrow(count, schema)


def source_name(source: Column) -> Column:
    """Case, blanks and hyphens do not make a new source; a blank one is null."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_")
    return F.when(name != "", name)


def _entropy(w: list[float]) -> float:
    return -sum(x * log(x) for x in w if x > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares to a power, normalised: 1 leaves them, 0 makes them even."""
    if not shares:
        return []
    logs = [exponent * log(s) for s in shares]
    top = max(logs)
    raw = [exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def exponent_for_entropy(shares: list[float], entropy: float) -> float:
    """The exponent in [0, 1] whose tempered shares have the entropy (natural log), or the nearest."""
    low, high = 0.0, 1.0
    if entropy <= _entropy(tempered(shares, 1.0)):
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _entropy(tempered(shares, mid)) > entropy else (low, mid)
    return (low + high) / 2


def between(natural: list[float], target: list[float], exponent: float) -> list[float]:
    """Natural shares times (target over natural) to a power, normalised: 0 natural, 1 target."""
    if not natural:
        return []
    logs = [log(n) + exponent * (log(t) - log(n)) for n, t in zip(natural, target, strict=True)]
    top = max(logs)
    raw = [exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


#: Relative play within which a share counts as being at its limit.
PLAY = 1e-9


def exponent_for_limits(natural: list[float], target: list[float], limits: list[float]) -> float:
    """An exponent in [0, 1] up to which every share keeps within its limit and beyond which one does not; 1 if all keep to it there, 0 if not even there."""
    fits = lambda e: all(x <= m * (1 + PLAY / 1000) for x, m in zip(between(natural, target, e), limits, strict=True))
    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def solve(available: dict[str, int], weights: dict[str, float], repeats: dict[str, float], budget: float | None = None, entropy: float | None = None) -> dict[str, dict[str, float]]:
    """For each source its target share, exponent and budget in tokens.

    Weights are divided by their sum.  Shares are the sources' token shares under a
    temperature: natural at exponent 0, the target at 1.  The exponent is bisected against
    the repetition limits; the budgets are the shares at that exponent.  A single exponent
    would hold every source off its target for the sake of one that is short, so only the
    sources that have reached their limit keep the share they have there, with the
    exponent at which they did; for the others, which share what is left, the exponent
    goes on.  At least one source is fixed a round, so it ends on any input.

    With ``entropy`` (natural log) the target is instead the sources' token shares to the
    power, in [0, 1], that is bisected to this entropy.  ``budget`` is the size of the
    mixture in tokens, by default that of the plan's sources.  Sources that do not occur
    or have no positive weight get nothing; if all limits together are below the budget,
    the mixture is smaller.
    """
    out = {s: {"target": 0.0, "exponent": 1.0, "budget": 0.0} for s in weights}
    total = sum(w for w in weights.values() if w > 0)
    for s, w in weights.items():
        out[s]["target"] = max(w, 0.0) / total if total else 0.0
    free = sorted(s for s in weights if available.get(s, 0) > 0 and weights[s] > 0)
    size = float(sum(available[s] for s in free)) if budget is None else float(budget)
    goal = {s: weights[s] for s in free}
    if entropy is not None and free:
        natural = [available[s] / sum(available[x] for x in free) for s in free]
        goal = dict(zip(free, tempered(natural, exponent_for_entropy(natural, entropy)), strict=True))
        for s in weights:
            out[s]["target"] = goal.get(s, 0.0)
    left = size
    while free and left > PLAY * size:
        natural = [available[s] / sum(available[x] for x in free) for s in free]
        target = [goal[s] / sum(goal[x] for x in free) for s in free]
        limits = [repeats[s] * available[s] / left for s in free]
        e = exponent_for_limits(natural, target, limits)
        shares = dict(zip(free, between(natural, target, e), strict=True))
        most = dict(zip(free, limits, strict=True))
        fixed = [s for s in free if e == 1.0 or shares[s] >= most[s] * (1 - PLAY)]
        fixed = fixed or [max(free, key=lambda s: shares[s] / most[s] if most[s] else inf)]
        for s in fixed:
            out[s]["exponent"], out[s]["budget"] = e, min(shares[s], most[s]) * left
        left -= sum(out[s]["budget"] for s in fixed)
        free = [s for s in free if s not in set(fixed)]
    return out


def mixture(sizes: DataFrame, targets: DataFrame, seed: int = 0, budget: float | None = None, entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of the mixtures and the shares reached.

    ``sizes`` has (doc_id, source, tokens), ``targets`` (plan, source, weight,
    max_repeats), at most MAX_TARGETS rows; of repeated targets the greatest counts.
    Rows (plan, source, doc_id, tokens, blocks, copies): a source is used in ``blocks``
    whole blocks, each a permutation of all its texts, and then in one more, up to the
    budget; ``ordered`` writes them out.  Texts without tokens or source, and sources
    without a target, are in no mixture.  Shares (plan, source, target_share, share,
    shortfall, tokens, available, repeats, exponent): of sources that do not occur, share
    and tokens are 0; ``shortfall`` is what a share lacks of its target.
    """
    spark = sizes.sparkSession
    used = cut(sizes.filter((F.col("tokens") > 0) & F.col("source").isNotNull()))
    goal = targets.filter("plan is not null and source is not null").groupBy("plan", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = goal.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    totals = {r["source"]: r["n"] for r in used.join(F.broadcast(goal.select("source").distinct()), "source").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    table = []
    for plan in sorted({r["plan"] for r in rows}):
        own = [r for r in rows if r["plan"] == plan]
        weights = {r["source"]: float(r["weight"] or 0) if r["weight"] is None or isfinite(r["weight"]) else 0.0 for r in own}
        repeats = {r["source"]: inf if r["max_repeats"] is None else max(0.0, float(r["max_repeats"])) for r in own}
        found = solve({r["source"]: totals.get(r["source"], 0) for r in own}, weights, repeats, budget, entropy)
        for r in own:
            x, n = found[r["source"]], totals.get(r["source"], 0)
            blocks = floor(x["budget"] / n + PLAY) if n else 0
            table.append((plan, r["source"], x["target"], x["exponent"], n, x["budget"], blocks, max(0.0, x["budget"] - blocks * n) if n else 0.0))
    plans = spark.createDataFrame(table, "plan string, source string, target_share double, exponent double, available bigint, budget double, blocks bigint, rest double")
    plans = F.broadcast(plans)
    group = ["plan", "source"]
    pool = used.join(plans.filter("budget > 0"), "source").withColumn("_at", _place(seed, F.col("blocks")))
    ranged = range_sorted(pool.select(*group, "doc_id", "tokens", "blocks", "rest", "_at"), group, ["_at", "doc_id"])
    parts, _ = with_offsets(ranged, group, "tokens")
    summed = running(ranged, parts, group, ["_at", "doc_id"], "tokens")
    copies = F.col("blocks") + (F.col("_cum") <= F.col("rest") + 1e-6).cast("int")
    out = cut(summed.select(*group, "doc_id", "tokens", "blocks", copies.alias("copies")).filter("copies > 0"), ranged)
    reached = out.groupBy(*group).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    whole = reached.groupBy("plan").agg(F.sum("tokens").alias("_whole"))
    shares = plans.join(reached, group, "left").join(whole, "plan", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    share = F.coalesce(tokens / F.col("_whole"), F.lit(0.0))
    repeated = F.when(F.col("available") > 0, tokens / F.col("available")).otherwise(F.lit(0.0))
    return out, shares.select(*group, "target_share", share.alias("share"), F.greatest(F.col("target_share") - share, F.lit(0.0)).alias("shortfall"), tokens.alias("tokens"), "available", repeated.alias("repeats"), "exponent")


def _place(seed: int, block: Column) -> Column:
    """Where a text stands in the permutation of a block."""
    return F.xxhash64(F.lit(seed), "plan", "source", block, "doc_id")


def ordered(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(plan, source, block, position, doc_id, tokens): the mixtures written out, block by block, each in its own order.

    As many rows as the mixtures have texts; a source without a limit of repeats is
    repeated as often as its share asks.
    """
    group = ["plan", "source", "block"]
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).withColumn("_at", _place(seed, F.col("block")))
    ranged = range_sorted(each.select(*group, "doc_id", "tokens", "_at").withColumn("_one", F.lit(1)), group, ["_at", "doc_id"])
    parts, _ = with_offsets(ranged, group, "_one")
    return running(ranged, parts, group, ["_at", "doc_id"], "_one").select(*group, (F.col("_cum") - 1).alias("position"), "doc_id", "tokens")
