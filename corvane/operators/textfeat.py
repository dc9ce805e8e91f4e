"""Features of decompiled text, and the classes that rule ladders give it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ladder

# Constants that say nothing.
NOISE_CONSTANTS = [0, 1, 2, 3, 4, 8, 0xF, 0xFF, 0xFFFF, 0xFFFFFFFF]
# Keywords of string literals in order, and the class and priority each gives.
STRING_CLASSES = [
    ("not implemented", "KNOWN_GAP", 5), ("unimplemented", "KNOWN_GAP", 5), (" todo ", "KNOWN_GAP", 5), ("fixme", "KNOWN_GAP", 5), ("stub", "PARTIAL_IMPL", 3),
    ("read-only", "TRAP_HANDLER", 4), ("read only", "TRAP_HANDLER", 4), ("write to read", "TRAP_HANDLER", 4), ("write to unused", "TRAP_HANDLER", 4), ("write to bios", "TRAP_HANDLER", 4), ("reserved", "TRAP_HANDLER", 4),
    ("deprecated", "LEGACY_CODE", 1), ("assert", "ASSERTION", 1), ("invalid", "VALIDATION_FAIL", 2), ("illegal", "VALIDATION_FAIL", 2), ("out of range", "VALIDATION_FAIL", 2), ("overflow", "VALIDATION_FAIL", 2),
]
# Fixed value: names of helper functions.
UTILITY_NAME = "(?i)(malloc|free|alloc|realloc|wrapper|stub|trampoline|telemetry|log(ging)?|trace|assert|fail_?fast|pure_?call|uncaught|exception_?context|unexpected|controlfp|barrier|purecall|_get_|_set_|__current_|__processing_)"


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def keyword_counts(text: Column) -> dict[str, Column]:
    """Loops, branches, switches, constants, floats, gotos and approximate cyclomatic number; null text has none."""
    branches, switches = count_of(text, r"if \("), count_of(text, r"switch \(")
    return {
        "loops": count_of(text, r"while \(|for \(|do \{"), "branches": branches, "switches": switches, "constants": count_of(text, "0x[0-9a-fA-F]+"),
        "has_float": F.coalesce(text.rlike("float|double"), F.lit(False)), "has_goto": F.coalesce(text.contains("goto "), F.lit(False)), "cyclomatic": branches + switches + 1,
    }


def ratios(text: Column, size: Column) -> dict[str, Column]:
    """Shares of operation kinds and densities by size; text of under 10 characters has zeros."""
    # The counting patterns, and below the thresholds of the classes.
    arith = count_of(text, r"0x[0-9a-fA-F]{4,}|>>|<<|\^|\*\s*0x|\*\s*[0-9]{4,}")
    loops, ifs, returns = count_of(text, r"\b(?:while|for)\b"), count_of(text, r"\bif\b"), count_of(text, r"\breturn\b")
    deref = count_of(text, r"\*\s*\(|\*[a-zA-Z_]|->")
    calls = count_of(text, r"\b[A-Za-z_]\w+\s*\(")
    # a name that is assigned and, as far as the pattern may give characters back, not called at once
    pointers = count_of(text, r"=\s*FUN_[0-9a-fA-F]+(?!\s*\()|=\s*[A-Z][A-Za-z0-9_]{3,}(?!\s*\()")
    total = F.greatest(arith + calls + deref + loops + ifs + returns, F.lit(1))
    sized = F.greatest(F.coalesce(size, F.lit(0)), F.lit(1))
    enough = F.coalesce(F.length(text) >= 10, F.lit(False))
    made = {
        "arith_ratio": F.round(arith / total, 3), "call_ratio": F.round(calls / total, 3), "deref_ratio": F.round(deref / total, 3),
        "if_density": F.round(ifs / sized, 4), "return_density": F.round(returns / sized, 4), "fptr_density": F.round(pointers / sized, 4),
    }
    return {k: F.when(enough, v).otherwise(F.lit(0.0)) for k, v in made.items()} | {"loop_count_text": F.when(enough, loops).otherwise(F.lit(0))}


def constants(text: Column) -> Column:
    """Array of the informative constants: hexadecimal numbers, and decimals from 1000, but for the noise values."""
    hexes = F.transform(F.regexp_extract_all(text, F.lit("0x([0-9a-fA-F]{1,15})(?![0-9a-fA-F])"), 1), lambda h: F.conv(h, 16, 10).cast("bigint"))
    decimals = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_.])([1-9][0-9]{3,17})(?![0-9A-Za-z_])"), 1), lambda d: d.cast("bigint"))
    noise = F.array(*[F.lit(x).cast("bigint") for x in NOISE_CONSTANTS])
    return F.filter(F.concat(hexes, decimals), lambda v: ~F.array_contains(noise, v))


def constant_profile(functions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, n_unique, small, medium, large, hw, entropy, struct_cluster) of each text's constants; texts of under 20 characters have zeros."""
    kept = functions.select(key, F.explode(F.when(F.length(text) >= 20, constants(F.col(text)))).alias("v"))
    each = kept.groupBy(key, "v").agg(F.count("*").alias("c"))
    total = each.groupBy(key).agg(F.sum("c").alias("t"))
    v, c = F.col("v"), F.col("c")
    low = F.when(v < 0x4000, c).otherwise(0)
    n_low, mean = F.sum(low), F.sum(low * v) / F.sum(low)
    spread = F.sqrt(F.greatest(F.sum(low * v * v) / F.sum(low) - mean * mean, F.lit(0.0)))
    out = each.join(total, key).groupBy(key).agg(
        F.sum("c").alias("n"), F.count("*").alias("n_unique"), F.sum(F.when(v < 0x2000, c).otherwise(0)).alias("small"), F.sum(F.when((v >= 0x2000) & (v < 0x10000), c).otherwise(0)).alias("medium"),
        F.sum(F.when((v >= 0x10000) & (v < 0x4000000), c).otherwise(0)).alias("large"), F.sum(F.when(v >= 0x4000000, c).otherwise(0)).alias("hw"),
        F.sum(-(c / F.col("t")) * F.log2(c / F.col("t"))).alias("entropy"), F.when(n_low >= 3, 1 / (1 + spread / mean)).otherwise(F.lit(0.0)).alias("struct_cluster"),
    )
    zero = {c: 0 for c in ("n", "n_unique", "small", "medium", "large", "hw", "entropy", "struct_cluster")}
    return functions.select(key).distinct().join(out, key, "left").na.fill(zero)


def string_class(text: Column) -> Column:
    """The class of the literals that say most: of the highest priority, the first; null without any."""
    literals = F.filter(F.transform(F.regexp_extract_all(text, F.lit('"([^"]{4,})"'), 1), F.lower), lambda s: s.rlike("[a-z] [a-z]"))
    by_priority = sorted(range(len(STRING_CLASSES)), key=lambda i: -STRING_CLASSES[i][2])
    # within a literal the first keyword of the list counts
    first = F.transform(literals, lambda s: ladder(*[(s.contains(k), c) for k, c, _ in STRING_CLASSES], otherwise=None))
    order = list(dict.fromkeys(STRING_CLASSES[i][1] for i in by_priority if STRING_CLASSES[i][2] > 1))
    last = F.get(F.filter(first, lambda x: x.isin("ASSERTION", "LEGACY_CODE")), F.lit(0))
    return F.coalesce(*[F.when(F.array_contains(first, c), F.lit(c)) for c in order], last)


def size_class(size: Column) -> Column:
    return ladder((size < 10, "TINY"), (size < 50, "SMALL"), (size < 200, "MEDIUM"), (size < 1000, "LARGE"), otherwise="MONOLITH")


def dominant_class(text: Column, fmt: Column, r: dict[str, Column], hw: Column, small: Column, struct_cluster: Column, ntstatus: Column, aligned: Column) -> Column:
    """The class of a function; the order of the branches is the meaning."""
    loops = r["loop_count_text"] > 0
    many_hw = (hw >= 3) & (struct_cluster < 0.5)
    return ladder(
        (text.isNull() | (F.length(text) == 0), "UNKNOWN"), (fmt == "KNOWN_GAP", "KNOWN_GAP"), (fmt == "TRAP_HANDLER", "TRAP_HANDLER"),
        ((r["fptr_density"] > 0.02) & (r["call_ratio"] < 0.30), "CPS_CALLBACK"), (ntstatus > 0.05, "GUARD"),
        (many_hw & (ntstatus > 0) & ~aligned, "GUARD"), (many_hw & (r["arith_ratio"] > 0.25), "COMPUTE"), (many_hw, "MMIO_DISPATCH"),
        ((struct_cluster > 0.6) & (small >= 3), "MEMORY"), (~loops & (r["return_density"] > 0.05), "GUARD"), (r["arith_ratio"] > 0.45, "COMPUTE"), (r["call_ratio"] > 0.40, "ORCHESTRATE"),
        (loops & (r["if_density"] > 0.06), "FLAG_DISPATCH"), (r["deref_ratio"] > 0.35, "MEMORY"), otherwise="MIXED",
    )


def is_simd(text: Column) -> Column:
    """At least two of five signs of vector code."""
    signs = [r"_mm\d*_|__m128|__m256", r"\bundefined16\b|\bxmm\d", r"CONCAT(88|412|124)", r"auVar\d+", r"\*\s*\(undefined1 \(\*\) ?\[16\]\)"]
    hits = sum((F.coalesce(text.rlike(s), F.lit(False)).cast("int") for s in signs[1:]), F.coalesce(text.rlike(signs[0]), F.lit(False)).cast("int"))
    return hits >= 2


def purity(text: Column) -> Column:
    """IMPURE writes a global, PURE_READS reads one, PURE touches none; null text is PURE."""
    return ladder((text.rlike(r"DAT_[0-9a-fA-F]+ ="), "IMPURE"), (text.rlike(r"DAT_[0-9a-fA-F]+"), "PURE_READS"), otherwise="PURE")


def uses_vtable(text: Column, callees: Column) -> Column:
    named = F.coalesce(F.exists(callees, lambda c: c.contains("guard_dispatch_icall")), F.lit(False))
    return named | F.coalesce(text.contains("(**(code") | text.contains("(*(code **)"), F.lit(False))


def utility_suspect(role: Column, size: Column, name: Column) -> Column:
    """At least two of: calls or shuffles only, is small, is named like a helper."""
    signs = [role.isin("CALLER", "REGISTER_HEAVY"), size < 48, name.rlike(UTILITY_NAME) & ~name.startswith("FUN_")]
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in signs[1:]), F.coalesce(signs[0], F.lit(False)).cast("int")) >= 2


def keyword_category(text: Column, categories: dict[str, list[str]]) -> Column:
    """The category with most keywords in the text, the first of equals; OTHER without any."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = {c: sum((t.contains(k).cast("int") for k in ks[1:]), t.contains(ks[0]).cast("int")) for c, ks in categories.items()}
    most = F.greatest(*hits.values(), F.lit(0)) if len(hits) > 1 else next(iter(hits.values()))
    return ladder((most == 0, "OTHER"), *[(h == most, c) for c, h in hits.items()], otherwise="OTHER")


def boundary_probes(texts: DataFrame, key: str, text: str, limit: int = 64) -> DataFrame:
    """(key, pos, value): values worth trying, from the literals and comparisons of a text.

    In order: fixed values, each literal and its neighbours, both sides of each
    comparison, powers of two; the first ``limit`` distinct ones.
    """
    # The baseline of probe values.
    base = [0, 1, -1, 2, 3, 7, 127, 128, 255, 256, 0x3F, 0x7F, 0x7FFF, 0x8000, 0xFFFF, 0x10000, 0x7FFFFFFF, 0x80000000, 0xFFFFFFFF, 2**32, 2**63 - 1]
    big = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    number = lambda s: F.when(s.startswith("0x"), F.conv(F.substring(s, 3, 15), 16, 10)).otherwise(F.substring(s, 1, 15)).cast("bigint")
    literals = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(0x[0-9a-f]{1,9}|[0-9]{1,10})\b"), 1), number), lambda v: (v > 1) & (v < 2**32))))
    near = F.flatten(F.transform(literals, lambda c: F.array(c - 1, c, c + 1)))
    compared = lambda op: F.transform(F.regexp_extract_all(text, F.lit(rf"[^<>=!]{op} (0x[0-9a-f]{{1,9}}|[0-9]{{1,10}})\b"), 1), number)
    sides = {"==": (0, 1), "!=": (1, 0), "<": (-1, 0), "<=": (0, 1), ">": (1, 0), ">=": (0, -1)}
    at = [F.flatten(F.transform(compared(op), _sides(a, b))) for op, (a, b) in sides.items()]
    powers = big([2**i for i in range(17)])
    values = F.slice(F.array_distinct(F.concat(big(base), F.coalesce(near, F.array().cast("array<bigint>")), *[F.coalesce(x, F.array().cast("array<bigint>")) for x in at], powers)), 1, limit)
    return texts.select(key, F.posexplode(values).alias("pos", "value"))


def _sides(a: int, b: int):
    zero = F.lit(0).cast("bigint")
    return lambda c: F.array(F.greatest(c + a, zero), F.greatest(c + b, zero))


def canonical_name(name: Column) -> Column:
    """A variable without its instance and width suffix, ``global_`` and ``field_`` shortened."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"_\d+_\d+$", ""), "^global_", "g_"), "^field_", "f_")


def integer_literal(text: Column) -> Column:
    """Hexadecimal or decimal text as bigint; null if it is neither."""
    t = F.trim(text)
    return F.when(t.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, -10).cast("bigint")).when(t.rlike("^[+-]?[0-9]{1,18}$"), t.cast("bigint"))
