"""Metrics of functions seen through their inputs and outputs.

An input-output map has rows (func, x, fx), one for each input of a function: of
repeated inputs the first by ``seq`` counts.  64-bit values are bit patterns in bigint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import add64, entropy_of, ladder, let, low32, mul64, shifted_xor


def first_writes(probes: DataFrame) -> DataFrame:
    """(func, x, fx) from (func, seq, x, fx): first write wins, nulls are no observations."""
    return probes.dropna(subset=["func", "x", "fx"]).groupBy("func", "x").agg(F.min_by("fx", F.struct("seq", "fx")).alias("fx"))


def flips(io: DataFrame, bits: int = 8) -> DataFrame:
    """(func, x, k, d): outputs of inputs that differ in bit k, as their exclusive or."""
    pairs = io.select("func", "x", "fx", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("k"))
    pairs = pairs.withColumn("y", F.col("x").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k"))))
    other = io.select("func", F.col("x").alias("y"), F.col("fx").alias("fy"))
    return pairs.join(other, ["func", "y"]).select("func", "x", "k", F.col("fx").bitwiseXOR(F.col("fy")).alias("d"))


def avalanche(io: DataFrame, bits: int = 8, width: int = 64) -> DataFrame:
    """(func, avalanche, deriv_const_frac): mean share of output bits that an input bit flips; share of bits with one derivative."""
    by_bit = flips(io, bits).groupBy("func", "k").agg(F.avg(F.bit_count("d") / width).alias("m"), F.countDistinct("d").alias("n"))
    return by_bit.groupBy("func").agg(F.avg("m").alias("avalanche"), F.avg((F.col("n") == 1).cast("double")).alias("deriv_const_frac"))


def output_shape(io: DataFrame) -> DataFrame:
    """(func, n_in, n_out, entropy, bijectivity, out_min, out_max, sentinel, sentinel_frac); entropy over log2(n_in), at most 1."""
    c = io.groupBy("func", "fx").agg(F.count("*").alias("c"))
    n = c.groupBy("func").agg(F.sum("c").alias("n"))
    return (
        c.join(n, "func").groupBy("func")
        .agg(
            F.max("n").alias("n_in"), F.count("*").alias("n_out"), F.when(F.max("n") > 1, F.least(F.lit(1.0), entropy_of(F.col("c") / F.col("n")) / F.log2(F.max("n")))).otherwise(F.lit(0.0)).alias("entropy"),
            (F.count("*") / F.max("n")).alias("bijectivity"), F.min("fx").alias("out_min"), F.max("fx").alias("out_max"), F.max_by("fx", F.struct("c", -F.col("fx").cast("decimal(20,0)"))).alias("sentinel"), (F.max("c") / F.max("n")).alias("sentinel_frac"),
        )
    )


def monotonicity(io: DataFrame) -> DataFrame:
    """(func, inc, dec): shares of consecutive inputs whose outputs do not fall, or do not rise."""
    nxt = F.lead("fx").over(Window.partitionBy("func").orderBy("x"))
    step = io.withColumn("_n", nxt).filter("_n is not null")
    return step.groupBy("func").agg(F.avg((F.col("_n") >= F.col("fx")).cast("double")).alias("inc"), F.avg((F.col("_n") <= F.col("fx")).cast("double")).alias("dec"))


def shifted(io: DataFrame, by: int) -> DataFrame:
    """(func, x, fx, fy): f(x) and f(x + by) where both were seen."""
    fits = F.col("x") >= F.lit(-(2**63) + by)
    other = io.filter(fits).select("func", (F.col("x") - F.when(fits, F.lit(by)).otherwise(F.lit(0))).alias("x"), F.col("fx").alias("fy"))
    return io.join(other, ["func", "x"])


def first_difference(io: DataFrame) -> DataFrame:
    """(func, delta_mean, delta_cv) of f(x + 1) - f(x); cv is the population deviation over the mean's size, 0 for a zero mean."""
    d = shifted(io, 1).select("func", (F.col("fy").cast("double") - F.col("fx").cast("double")).alias("d"))
    mean = F.avg("d")
    return d.groupBy("func").agg(mean.alias("delta_mean"), F.when(mean != 0, F.stddev_pop("d") / F.abs(mean)).otherwise(F.lit(0.0)).alias("delta_cv"))


def periodicity(io: DataFrame) -> DataFrame:
    """(func, period2, period3): shares of inputs with the output of the input 2 or 3 further."""
    p2 = shifted(io, 2).groupBy("func").agg(F.avg((F.col("fx") == F.col("fy")).cast("double")).alias("period2"))
    p3 = shifted(io, 3).groupBy("func").agg(F.avg((F.col("fx") == F.col("fy")).cast("double")).alias("period3"))
    return p2.join(p3, "func", "full").na.fill(0.0, ["period2", "period3"])


def additivity(io: DataFrame, first: int = 20) -> DataFrame:
    """(func, n_pairs, add_linear): share of pairs x < y of the first inputs with f(x + y) = f(x) + f(y) mod 2**64.

    The pairs are of the first 20 inputs by definition, not of all.
    """
    head = io.withColumn("_r", F.row_number().over(Window.partitionBy("func").orderBy("x"))).filter(F.col("_r") <= first)
    pairs = head.alias("p").join(head.alias("q"), (F.col("p.func") == F.col("q.func")) & (F.col("p._r") < F.col("q._r"))).select(F.col("p.func").alias("func"), add64(F.col("p.x"), F.col("q.x")).alias("x"), add64(F.col("p.fx"), F.col("q.fx")).alias("s"))
    return pairs.join(io, ["func", "x"]).groupBy("func").agg(F.count("*").alias("n_pairs"), F.avg((F.col("fx") == F.col("s")).cast("double")).alias("add_linear"))


def anf_degree(io: DataFrame, bits: int = 5) -> DataFrame:
    """(func, anf_degree): over the low output bits, the most inputs that meet in one product of the algebraic normal form.

    Inputs 0..31; missing ones are 0, and with fewer than 16 the degree is -1.
    """
    size = 1 << bits
    low = io.filter((F.col("x") >= 0) & (F.col("x") < size))
    present = low.groupBy("func").agg(F.count("*").alias("n"))
    # a coefficient is the exclusive or over the inputs within its mask
    masks = low.select("func", "x", "fx", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("s")).filter(F.col("x").bitwiseAND(F.col("s").cast("bigint")) == F.col("x"))
    coefficients = masks.groupBy("func", "s").agg(F.bit_xor("fx").alias("c"))
    degree = coefficients.filter(F.col("c").bitwiseAND(F.lit(size - 1).cast("bigint")) != 0).groupBy("func").agg(F.max(F.bit_count("s")).alias("d"))
    return present.join(degree, "func", "left").select("func", F.when(F.col("n") < size // 2, -1).otherwise(F.coalesce("d", F.lit(0))).alias("anf_degree"))


def timing(probes: DataFrame, elapsed: str, error: str) -> DataFrame:
    """(func, timing_cv) over calls without error and with a positive finite time."""
    t = F.col(elapsed)
    ok = probes.filter(F.col(error).isNull() & (t > 0) & ~F.isnan(t) & (t < float("inf")))
    return ok.groupBy("func").agg((F.stddev_pop(t) / F.abs(F.avg(t))).alias("timing_cv"))


def identity_flags(io: DataFrame) -> DataFrame:
    """(func, is_boolean, is_constant, is_near_identity)."""
    err = F.avg(F.when(F.col("x") != 0, F.abs(F.col("fx").cast("double") - F.col("x").cast("double")) / F.abs(F.col("x").cast("double"))))
    return io.groupBy("func").agg(F.bool_and(F.col("fx").isin(0, 1)).alias("is_boolean"), (F.count_distinct("fx") == 1).alias("is_constant"), F.coalesce(err < 0.01, F.lit(False)).alias("is_near_identity"))


def metrics(io: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """All metrics of each function in one row; 0 where a metric has no observations, -1 for the degree."""
    out = output_shape(io)
    for part in (avalanche(io), monotonicity(io), first_difference(io), periodicity(io), additivity(io).drop("n_pairs"), anf_degree(io), identity_flags(io)):
        out = out.join(part, "func", "left")
    out = out.join(times, "func", "left") if times is not None else out.withColumn("timing_cv", F.lit(0.0))
    return out.na.fill(0.0, ["avalanche", "deriv_const_frac", "inc", "dec", "delta_mean", "delta_cv", "period2", "period3", "add_linear", "timing_cv"]).na.fill(-1, ["anf_degree"])


def function_class() -> Column:
    """Struct (func_class, confidence) from the columns of ``metrics``; the first branch that holds."""
    c = F.col
    mono = F.greatest(c("inc"), c("dec"))
    rungs = [
        (c("is_constant") & (c("timing_cv") > 0.15), "stateful", 0.80), (c("is_constant"), "constant", 0.95), (c("is_near_identity"), "identity", 0.90),
        (c("is_boolean") & (c("sentinel_frac") > 0.50), "guard", 0.80), (c("is_boolean"), "guard", 0.70), ((c("sentinel_frac") > 0.40) & (c("avalanche") < 0.30), "guard", 0.75),
        (c("deriv_const_frac") > 0.80, "cipher", 0.80), (mono > 0.80, "arith", 0.75), ((c("avalanche") > 0.40) & (c("bijectivity") > 0.70) & (c("entropy") > 0.70), "prng", 0.70),
        ((c("avalanche") > 0.35) & (c("entropy") > 0.60), "hash", 0.65), ((c("bijectivity") < 0.50) & (c("entropy") > 0.30) & (c("avalanche") < 0.40), "checksum", 0.55),
    ]
    out = F.when(rungs[0][0], F.struct(F.lit(rungs[0][1]).alias("func_class"), F.lit(rungs[0][2]).alias("confidence")))
    for condition, label, confidence in rungs[1:]:
        out = out.when(condition, F.struct(F.lit(label).alias("func_class"), F.lit(confidence).alias("confidence")))
    return out.otherwise(F.struct(F.lit("unknown").alias("func_class"), F.lit(0.30).alias("confidence")))


def synopsis() -> Column:
    """The signs that hold, in order, from the columns of ``metrics``."""
    c = F.col
    signs = [
        (c("is_constant"), "CONSTANT"), (c("is_boolean"), "BOOLEAN"), (c("is_near_identity"), "IDENTITY"), (c("avalanche") > 0.45, "HIGH_AVALANCHE"), (c("avalanche") < 0.05, "LOW_AVALANCHE"), (c("entropy") > 0.90, "HIGH_ENTROPY"),
        (c("entropy") < 0.10, "LOW_ENTROPY"), (c("bijectivity") > 0.95, "BIJECTIVE"), (c("add_linear") > 0.90, "LINEAR"), (c("inc") > 0.90, "INCREASING"), (c("dec") > 0.90, "DECREASING"), (c("period2") > 0.90, "PERIOD2"),
        (c("period3") > 0.90, "PERIOD3"), ((c("delta_cv") < 0.05) & (c("delta_mean") != 0), "CONST_DELTA"), (c("sentinel_frac") > 0.30, "SENTINEL"), (c("timing_cv") > 0.50, "TIMING_VARIES"), (c("timing_cv") < 0.10, "TIMING_FLAT"),
    ]
    return F.concat_ws(" ", *[F.when(s, n) for s, n in signs])


# Reference functions, as column expressions over 64-bit patterns; the numbers are fixed values of public algorithms.
def _murmur(x: Column) -> Column:
    h = low32(x)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = low32(mul64(shifted_xor(h, right=shift), factor))
    return shifted_xor(h, right=16)


def _xxhash(x: Column) -> Column:
    h = low32(x)
    for shift, factor in ((15, 2246822519), (13, 3266489917)):
        h = low32(mul64(shifted_xor(h, right=shift), factor))
    return shifted_xor(h, right=16)


def _splitmix(x: Column) -> Column:
    z = add64(x, F.lit(0x9E3779B97F4A7C15 - 2**64).cast("bigint"))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = mul64(shifted_xor(z, right=shift), factor)
    return shifted_xor(z, right=31)


def _xorshift64(x: Column) -> Column:
    for right, left in ((0, 13), (7, 0), (0, 17)):
        x = shifted_xor(x, right, left)
    return x


def _xorshift32(x: Column) -> Column:
    x = low32(x)
    for right, left in ((0, 13), (17, 0), (0, 5)):
        x = low32(shifted_xor(x, right, left))
    return x


def _lcg(x: Column) -> Column:
    return low32(add64(mul64(x, 1103515245), F.lit(12345).cast("bigint")))


def _crc(x: Column, polynomial: int) -> Column:
    """The state after a byte of 0: eight steps of the reflected polynomial over its last byte."""
    rest = low32(F.shiftrightunsigned(x, 8))
    c = x.bitwiseAND(F.lit(255).cast("bigint"))
    for _ in range(8):
        c = let(c, lambda v: F.when(v.bitwiseAND(F.lit(1).cast("bigint")) == 1, F.shiftrightunsigned(v, 1).bitwiseXOR(F.lit(polynomial).cast("bigint"))).otherwise(F.shiftrightunsigned(v, 1)))
    return c.bitwiseXOR(rest)


def _adler(x: Column) -> Column:
    a = x.bitwiseAND(F.lit(0xFFFF).cast("bigint")) % 65521
    b = F.shiftrightunsigned(x, 16).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return F.shiftleft((b + a) % 65521, 16).bitwiseOR(a)


def _pcg(x: Column) -> Column:
    """The output permutation: 32 bits, turned right by the five upper bits of the state."""
    word, turn = low32(F.shiftrightunsigned(shifted_xor(x, right=18), 27)), F.shiftrightunsigned(x, 59).cast("int")
    return let(F.struct(word.alias("w"), turn.alias("t")), lambda s: low32(F.call_function("shiftrightunsigned", s["w"], s["t"]).bitwiseOR(F.call_function("shiftleft", s["w"], 32 - s["t"]))))


# The registry's functions and their kinds, in its order. Functions of a state and a byte take the byte 0.
REFERENCE_FUNCTIONS = {
    "xorshift64": _xorshift64, "xorshift32": _xorshift32, "splitmix64": _splitmix, "pcg32_output": _pcg, "pcg32_step": _pcg, "lcg_glibc": _lcg, "murmur3_fmix32": _murmur, "xxhash32_avalanche": _xxhash,
    "djb2_add": lambda x: mul64(x, 33), "djb2_xor": lambda x: mul64(x, 33), "fnv1a_32": lambda x: low32(mul64(x, 0x01000193)), "fnv1a_64": lambda x: mul64(x, 0x100000001B3),
    "crc32_ieee": lambda x: _crc(x, 0xEDB88320), "crc32c": lambda x: _crc(x, 0x82F63B78), "adler32_step": _adler,
}
REFERENCE_KINDS = {
    "xorshift64": "prng", "xorshift32": "prng", "splitmix64": "prng", "pcg32_output": "prng", "pcg32_step": "prng", "lcg_glibc": "prng", "murmur3_fmix32": "hash", "xxhash32_avalanche": "hash",
    "djb2_add": "hash", "djb2_xor": "hash", "fnv1a_32": "hash", "fnv1a_64": "hash", "crc32_ieee": "checksum", "crc32c": "checksum", "adler32_step": "checksum",
}


def admitted(kind: str) -> Column:
    """Whether the columns of ``metrics`` allow a reference function of this kind."""
    c = F.col
    return {
        "hash": (c("avalanche") > 0.35) & (c("entropy") > 0.70) & ~c("is_constant") & (c("inc") < 0.80), "prng": (c("avalanche") > 0.35) & (c("bijectivity") > 0.70) & ~c("is_constant") & (c("entropy") > 0.60),
        "checksum": (c("bijectivity") < 0.70) & ~c("is_constant") & (c("entropy") > 0.50), "cipher": c("deriv_const_frac") > 0.70, "arith": (c("inc") > 0.75) | (c("dec") > 0.75),
    }.get(kind, F.lit(True))


def filtered_matches(matches: DataFrame, measured: DataFrame) -> DataFrame:
    """``matches`` of functions whose metrics admit the reference function's kind."""
    kinds = F.create_map(*[F.lit(x) for p in REFERENCE_KINDS.items() for x in p])
    flags = F.array_compact(F.array(*[F.when(admitted(k), k) for k in ("hash", "prng", "checksum", "cipher", "arith")]))
    return matches.join(measured.select("func", flags.alias("_ok")), "func").filter(F.array_contains("_ok", kinds[F.col("vector")])).drop("_ok")


def reference_matches(io: DataFrame, functions: dict | None = None) -> DataFrame:
    """(func, vector, score): share of inputs where a reference function gives the output; all functions in one pass."""
    functions = functions or REFERENCE_FUNCTIONS
    hits = [F.avg((f(F.col("x")) == F.col("fx")).cast("double")).alias(n) for n, f in functions.items()]
    wide = io.groupBy("func").agg(*hits)
    return wide.select("func", F.explode(F.array(*[F.struct(F.lit(n).alias("vector"), F.col(n).alias("score")) for n in functions])).alias("m")).select("func", "m.vector", "m.score")


def resolved_class(measured: DataFrame, best: DataFrame) -> DataFrame:
    """(func, func_class, confidence, vector) of ``metrics``: the kind of the best match where its score is beyond the ladder's confidence, else the ladder's class."""
    kinds = F.create_map(*[F.lit(x) for p in REFERENCE_KINDS.items() for x in p])
    m = measured.select("func", function_class().alias("c")).join(best, "func", "left")
    over = F.coalesce(F.col("score") > F.col("c.confidence"), F.lit(False))
    return m.select("func", F.when(over, kinds[F.col("vector")]).otherwise(F.col("c.func_class")).alias("func_class"), F.when(over, F.col("score")).otherwise(F.col("c.confidence")).alias("confidence"), F.when(over, F.col("vector")).alias("vector"))


def best_match(matches: DataFrame, order: list[str], least: float = 0.70) -> DataFrame:
    """(func, vector, score): the best match of each function from ``least`` on; equal scores by the order of the registry."""
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("vector"))
    best = matches.groupBy("func").agg(F.max_by("vector", F.struct("score", -place)).alias("vector"), F.max("score").alias("score"))
    return best.filter(F.col("score") >= least)


def discriminating(io: DataFrame, n: int = 16) -> DataFrame:
    """(func, x, fx): at most n inputs: the first of each output by size of the input, then both sides of changes, then an even sample; by x."""
    w = Window.partitionBy("func")
    r = io.withColumn("_first", F.row_number().over(Window.partitionBy("func", "fx").orderBy(F.abs("x"), "x")) == 1)
    r = r.withColumn("_edge", (F.lag("fx").over(w.orderBy("x")) != F.col("fx")) | (F.lead("fx").over(w.orderBy("x")) != F.col("fx")))
    r = r.withColumn("_i", F.row_number().over(w.orderBy("x")) - 1).withColumn("_n", F.count("*").over(w))
    stride = F.col("_i") % F.greatest(F.floor(F.col("_n") / n), F.lit(1)) == 0
    r = r.withColumn("_p", F.when(F.col("_first"), 0).when(F.coalesce("_edge", F.lit(False)), 1).when(stride, 2).otherwise(3)).filter("_p < 3")
    return r.withColumn("_k", F.row_number().over(w.orderBy("_p", F.abs("x"), "x"))).filter(F.col("_k") <= n).select("func", "x", "fx")


def transitions(io: DataFrame) -> DataFrame:
    """(func, x, fx): the inputs on both sides of every change of the output."""
    w = Window.partitionBy("func").orderBy("x")
    edge = (F.lag("fx").over(w) != F.col("fx")) | (F.lead("fx").over(w) != F.col("fx"))
    return io.withColumn("_e", edge).filter("_e").select("func", "x", "fx")
