"""Repeated patterns: rules, their presence in functions, lift, coverage and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import ladder

#: Size of a grammar.
TOP_RULES = 300


def frequent_runs(corpus: DataFrame, n: int = 2, top: int = TOP_RULES) -> DataFrame:
    """(rule_id, count, expansion): the most frequent runs of n tokens, the rule provider.

    Runs within a function only; ties by expansion.  ``top`` is the size of the grammar.
    """
    at = F.sequence(F.lit(0), F.size("tokens") - n)
    runs = corpus.filter(F.size("tokens") >= n).select(F.explode(F.transform(at, lambda i: F.array_join(F.slice("tokens", i + 1, n), " "))).alias("e"))
    counts = runs.groupBy("e").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "e").limit(top)
    ranked = counts.withColumn("rule_id", F.row_number().over(Window.orderBy(F.desc("count"), "e")) - 1)
    return ranked.select("rule_id", "count", F.split("e", " ").alias("expansion"))


def rule_label(expansion: Column) -> Column:
    """What a rule looks like, by the first pattern that its tokens match."""
    s = F.array_join(expansion, " ")
    return ladder(
        (s.contains("OVERFLOW_CHECK") & s.contains("INT_SCMP") & s.contains("INT_EQUAL"), "flag-update block"),
        (s.contains("INT_AND_1") & s.contains("INT_SCMP_1"), "flag artifact"),
        (s.rlike("INT_ADD_8.*(STORE_8|STORE_4)"), "field WRITE"),
        (s.rlike("INT_ADD_8.*LOAD_(8|4)"), "field READ"),
        (s.rlike("LOAD_8.*INT_EQUAL_1.*CBRANCH"), "null pointer guard"),
        (s.rlike("COPY_8.*INT_EQUAL_1.*CBRANCH"), "value null-check"),
        (s.contains("FLOAT_ARITH"), "float computation"),
        (s.contains("FLOAT_CAST"), "conversion"),
        (s.contains("BRANCHIND"), "dispatch"),
        (F.forall(expansion, lambda t: t.startswith("COPY")), "register shuffling"),
        otherwise="",
    )


def presence(corpus: DataFrame, rules: DataFrame) -> DataFrame:
    """(label, fn_id, rule_id) where all tokens of a rule occur in the function; a rule without tokens is nowhere.

    A rule is joined to functions by the token of it that the fewest functions have; the
    others are looked up in the function's own tokens.  So a function meets few rules it
    does not hold.  The rules are a grammar of bounded size and are what is broadcast, never
    the functions: left to itself, Spark takes the size of a compressed file for theirs.
    """
    own = corpus.select("label", "fn_id", F.array_distinct("tokens").alias("_t"))
    each = rules.select("rule_id", F.array_distinct("expansion").alias("_terms")).withColumn("token", F.explode("_terms"))
    named = F.broadcast(each.select("token").distinct())
    held = own.select(F.explode("_t").alias("token")).join(named, "token").groupBy("token").agg(F.count("*").alias("_c"))
    # a token that no function has is the rarest
    counted = each.join(F.broadcast(held), "token", "left").select("rule_id", "_terms", F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "token").alias("_r"))
    rarest = counted.groupBy("rule_id", "_terms").agg(F.min("_r")["token"].alias("_key"))
    met = own.withColumn("_key", F.explode("_t")).join(F.broadcast(rarest), "_key")
    return met.filter(F.forall("_terms", lambda x: F.array_contains("_t", x))).select("label", "fn_id", "rule_id")


def rule_weights(present: DataFrame, rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule_id, p, weight): share of functions and variance weight p (1 - p) over the greatest."""
    n = corpus.agg(F.count("*").alias("_n"))
    p = rules.select("rule_id").join(present.groupBy("rule_id").agg(F.count("*").alias("_k")), "rule_id", "left").join(F.broadcast(n))
    p = p.withColumn("p", F.coalesce("_k", F.lit(0)) / F.greatest("_n", F.lit(1)))
    var = F.col("p") * (1 - F.col("p"))
    top = p.agg(F.max(var).alias("_max"))
    return p.join(F.broadcast(top)).select("rule_id", "p", (var / F.when(F.col("_max") == 0, 1.0).otherwise(F.col("_max"))).alias("weight"))


def coverage(present: DataFrame, corpus: DataFrame, rules: DataFrame) -> DataFrame:
    """(label, fn_id, coverage): share of all rules present; 0 for functions without any."""
    hits = present.groupBy("fn_id").agg(F.count("*").alias("_k"))
    n = F.broadcast(rules.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n")))
    return corpus.select("label", "fn_id").join(hits, "fn_id", "left").join(n).select("label", "fn_id", (F.coalesce("_k", F.lit(0)) / F.col("_n")).alias("coverage"))


def coverage_verdict(c: Column) -> Column:
    return ladder((c < 0.20, "low"), (c < 0.35, "moderate"), (c < 0.50, "good"), otherwise="high")


def lift(present: DataFrame, corpus: DataFrame, by: str) -> DataFrame:
    """(by, rule_id, local, overall, lift): a rule's share within a group minus its share overall.

    What is present is counted once, by group; the counts overall are sums of these.
    """
    size = corpus.groupBy(by).agg(F.count("*").alias("_size"))
    whole = corpus.agg(F.count("*").alias("_all"))
    held = present.filter("rule_id is not null").groupBy(by, "rule_id").agg(F.count("*").alias("_n"))
    overall = F.sum("_n").over(Window.partitionBy("rule_id")) / F.col("_all")
    local = held.join(F.broadcast(whole)).withColumn("overall", overall).join(size, by)
    return local.select(by, "rule_id", (F.col("_n") / F.col("_size")).alias("local"), "overall", (F.col("_n") / F.col("_size") - F.col("overall")).alias("lift"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def profile_cosine(present: DataFrame, corpus: DataFrame) -> DataFrame:
    """(a, b, cosine) of the labels' mean rule vectors, a < b; labels are few (one per binary).

    Dot products are summed per rule, so only labels that share a rule meet.
    """
    size = corpus.groupBy("label").agg(F.count("*").alias("_size"))
    v = present.groupBy("label", "rule_id").agg(F.count("*").alias("_n")).join(size, "label").select("label", "rule_id", (F.col("_n") / F.col("_size")).alias("x"))
    norm = v.groupBy("label").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    dot = v.select(F.col("label").alias("a"), "rule_id", F.col("x").alias("xa")).join(v.select(F.col("label").alias("b"), "rule_id", F.col("x").alias("xb")), "rule_id").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    na, nb = norm.select(F.col("label").alias("a"), F.col("norm").alias("na")), norm.select(F.col("label").alias("b"), F.col("norm").alias("nb"))
    return dot.join(na, "a").join(nb, "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def archetype(text: Column) -> Column:
    """Archetype of a cluster from its strongest rules, joined and lower-cased; the first that holds."""
    t = F.lower(text)
    has = t.contains
    return ladder(
        (has("load_8 int_add_8 return") | has("load_8 copy_8 int_add_8 return"), "GETTER"),
        (has("branchind"), "DISPATCHER"),
        (has("float_arith") | has("float_cast"), "FLOAT_COMPUTE"),
        (has("bool_op_1 cbranch"), "GUARD_COMPOUND"),
        (has("int_equal_1") & has("cbranch"), "GUARD_SIMPLE"),
        (has("store_16") | has("load_16"), "SIMD_COPY"),
        (has("int_add_8 copy_8 store_8") & ~has("load"), "WRITER"),
        (has("int_add_8 load_8 copy_8"), "READER"),
        (has("call __sep__") | has("callind __sep__"), "CALLER"),
        (has("copy_8 copy_8 copy_8"), "REGISTER_HEAVY"),
        (has("overflow_check") | has("int_ucmp"), "ARITHMETIC"),
        otherwise="MIXED",
    )


def share_matrix(members: DataFrame, row: str, column: str) -> DataFrame:
    """(column, row, n, share): how each column value's members spread over the rows."""
    n = members.groupBy(column, row).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(column)))


def domain_fingerprint(isolation: Column, arithmetic: Column, guard: Column, getter: Column, caller: Column, writer: Column, mixed: Column) -> Column:
    """What a binary is like from its fractions; isolation in percent."""
    return ladder(
        (isolation > 40, "Statically opaque"), (arithmetic > 0.20, "Arithmetic-heavy"), (guard > 0.30, "Validation-heavy"), (getter > 0.25, "Accessor-heavy"),
        (caller > 0.35, "Orchestration-heavy"), (writer > 0.25, "State-writing"), (mixed > 0.25, "Mixed"), otherwise=None,
    )
