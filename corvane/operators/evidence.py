"""Evidence logs: stability of observations, upserts, tiers and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ladder, upper_median

# The order of tiers.
TIERS = ["EPHEMERAL", "COMMON", "INVARIANT"]


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)


def at_least(df: DataFrame, tier: str, column: str = "stability") -> DataFrame:
    return df.filter(tier_rank(F.col(column)) >= TIERS.index(tier) + 1)


def session_stability(observations: DataFrame) -> DataFrame:
    """(addr_key, value, n_sessions, freq, stability) of observations (session, addr_key, value).

    Every session INVARIANT, three quarters COMMON, one of several UNIQUE, else EPHEMERAL.
    """
    total = observations.agg(F.count_distinct("session").alias("n_all"))
    seen = observations.groupBy("addr_key", "value").agg(F.count_distinct("session").alias("n_sessions"), F.count("*").alias("n_seen"))
    share = F.col("n_sessions") / F.col("n_all")
    kind = ladder((share >= 1.0, "INVARIANT"), (share >= 0.75, "COMMON"), (F.col("n_sessions") == 1, "UNIQUE"), otherwise="EPHEMERAL")
    return seen.join(F.broadcast(total)).select("addr_key", "value", "n_sessions", "n_seen", share.alias("freq"), kind.alias("stability"))


def address_stability(observations: DataFrame) -> DataFrame:
    """(addr_key, representative, spread, kind) of observed addresses (addr_key, addr); the upper median stands for them."""
    spread = F.stddev_pop("addr")
    g = observations.groupBy("addr_key").agg(F.min("addr").alias("lo"), F.max("addr").alias("hi"), spread.alias("spread"), upper_median(F.col("addr")).alias("representative"))
    kind = ladder((F.col("lo") == F.col("hi"), "ADDRESS_STATIC"), (F.col("spread") < 1 << 20, "HEAP_STABLE"), (F.col("spread") < 64 << 20, "HEAP_MODERATE"), otherwise="VOLATILE")
    return g.select("addr_key", "representative", "spread", kind.alias("kind"))


def against_verified(stable: DataFrame, verified: DataFrame) -> DataFrame:
    """Stable values with KNOWN_KEY where ``verified`` (value) has them, else UNKNOWN_INVARIANT."""
    flag = verified.select("value", F.lit(True).alias("_known")).distinct()
    kept = stable.filter(F.col("stability").isin("INVARIANT", "COMMON"))
    return kept.join(flag, "value", "left").withColumn("verdict", F.when(F.col("_known"), "KNOWN_KEY").otherwise("UNKNOWN_INVARIANT")).drop("_known")


def canonical(payload: Column) -> Column:
    """JSON text of a flat map with its keys in order; null if it can't be read."""
    m = F.from_json(payload, "map<string,string>")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def fact_id(kind: Column, payload: Column) -> Column:
    """Twelve digits of SHA-1 over the type and the canonical payload."""
    return F.substring(F.sha1(F.concat_ws(":", kind, payload)), 1, 12)


def upserted(observations: DataFrame) -> DataFrame:
    """One row per fact of observations (obs_type, payload, layer, ts): counters, layers, first and last sight, stability.

    A full recomputation, so it is the same however often it runs: three layers or five
    sights INVARIANT, two layers or three sights COMMON.
    """
    keyed = observations.withColumn("_p", canonical(F.col("payload"))).withColumn("id", fact_id(F.col("obs_type"), F.col("_p")))
    g = keyed.groupBy("id", "obs_type", F.col("_p").alias("payload")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("layer")).alias("layers"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    n, k = F.col("n"), F.size("layers")
    return g.withColumn("stability", ladder(((k >= 3) | (n >= 5), "INVARIANT"), ((k >= 2) | (n >= 3), "COMMON"), otherwise="EPHEMERAL"))


def summary(facts: DataFrame) -> DataFrame:
    """(obs_type, stability, n) with both totals (null)."""
    return facts.cube("obs_type", "stability").agg(F.count("*").alias("n"))


def field_map(observations: DataFrame) -> DataFrame:
    """(struct_name, fields): map of offset to name; the last observation wins."""
    last = observations.groupBy("struct_name", "offset").agg(F.max_by("name", F.struct("seq", "name")).alias("name"))
    return last.groupBy("struct_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("offset", "name")))).alias("fields"))


def unambiguous(observations: DataFrame) -> DataFrame:
    """(offset, name) where all observations agree."""
    return observations.groupBy("offset").agg(F.count_distinct("name").alias("_n"), F.min("name").alias("name")).filter("_n = 1").drop("_n")


def memory_transitions(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """(func, va, before, after, consistent): the most frequent values around a call, and whether every call changed it alike.

    ``changes`` has (func, va, call, before, after), ``calls`` (func, n_calls).
    """
    b = changes.groupBy("func", "va", "before").agg(F.count("*").alias("c")).groupBy("func", "va").agg(F.max_by("before", F.struct("c", -F.col("before"))).alias("before"))
    a = changes.groupBy("func", "va", "after").agg(F.count("*").alias("c")).groupBy("func", "va").agg(F.max_by("after", F.struct("c", -F.col("after"))).alias("after"))
    n = changes.groupBy("func", "va").agg(F.count_distinct("call").alias("n"), F.count_distinct("before").alias("nb"), F.count_distinct("after").alias("na")).join(calls, "func")
    return n.join(b, ["func", "va"]).join(a, ["func", "va"]).select("func", "va", "before", "after", ((F.col("n") == F.col("n_calls")) & (F.col("nb") == 1) & (F.col("na") == 1)).alias("consistent"))


def field_types(snapshots: DataFrame) -> DataFrame:
    """(offset, kind, mutated) of unsigned values (offset, value) seen over calls."""
    v = F.col("value")
    g = snapshots.groupBy("offset").agg(F.count_distinct("value").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.bool_and(v.isin(0, 1)).alias("bit"), F.bool_and((v == 0) | (v >= 0x10000)).alias("far"))
    kind = ladder((F.col("bit") & (F.col("n") > 1), "BOOL"), (F.col("n") == 1, "CONSTANT"), (F.col("far") & (F.col("hi") > 0xFFFFFFFF), "POINTER"), (F.col("hi") > 0xFFFFFFFF, "INT64"), (F.col("hi") < 0x10000, "SMALL_INT"), otherwise="UINT32")
    return g.select("offset", kind.alias("kind"), (F.col("n") > 1).alias("mutated"))


def accuracy(results: DataFrame) -> DataFrame:
    """One row (total, correct, wrong, crashed, accuracy) of results (expected, got, error)."""
    crash = F.col("error").isNotNull()
    ok = ~crash & (F.col("got") == F.col("expected"))
    wrong = ~crash & ~F.coalesce(F.col("got") == F.col("expected"), F.lit(False))
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.count_if(wrong).alias("wrong"), F.count_if(crash).alias("crashed"), F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("accuracy"))


def investigations(events: DataFrame) -> DataFrame:
    """(item, status, n_events, closed) from (item, seq, status): the last status by seq; nothing after a closing counts."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("item").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    live = events.withColumn("_shut", F.coalesce(F.max((F.col("status") == "closed").cast("int")).over(w), F.lit(0))).filter("_shut = 0")
    return live.groupBy("item").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("n_events"), F.bool_or(F.col("status") == "closed").alias("closed"))


def appended(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; of several new ones with one key the least."""
    fresh = new.join(old.select(*key).distinct(), key, "left_anti")
    rest = [c for c in fresh.columns if c not in key]
    first = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else fresh.distinct()
    return old.unionByName(first.select(*old.columns))
