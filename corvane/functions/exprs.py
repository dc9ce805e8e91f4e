"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(*branches: tuple[Column, str], otherwise: str | None) -> Column:
    """The label of the first branch that holds; a null condition does not hold."""
    out = F.when(branches[0][0], branches[0][1])
    for condition, label in branches[1:]:
        out = out.when(condition, label)
    return out.otherwise(F.lit(otherwise))


def entropy_of(share: Column) -> Column:
    """Aggregate: Shannon entropy in bits of shares that add up to 1."""
    return F.sum(F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0)))


def upper_median(values: Column) -> Column:
    """Aggregate: the element at floor(n / 2) of the sorted values; an order statistic, not an average of two."""
    s = F.array_sort(F.collect_list(values))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def percentile_floor(values: Column, percent: int) -> Column:
    """Of an array: the element at floor(n p / 100) of the sorted values, at most the last."""
    s = F.array_sort(values)
    return F.get(s, F.least(F.floor(F.size(s) * percent / 100), F.size(s) - 1).cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it; chains stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def add64(a: Column, b: Column) -> Column:
    """Sum modulo 2**64, on 32-bit halves, so that it wraps where ANSI arithmetic would fail."""
    low_mask = F.lit(0xFFFFFFFF).cast("bigint")

    def halves(s: Column) -> Column:
        low = s["a"].bitwiseAND(low_mask) + s["b"].bitwiseAND(low_mask)
        high = F.shiftrightunsigned(s["a"], 32) + F.shiftrightunsigned(s["b"], 32) + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(low_mask))

    return let(F.struct(a.alias("a"), b.alias("b")), halves)


def mul64(x: Column, constant: int) -> Column:
    """Product with a constant modulo 2**64, by sixteen-bit limbs of the constant."""

    def limbs(v: Column) -> Column:
        low, high = v.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(v, 32)
        parts = []
        for i in range(4):
            limb = constant >> (16 * i) & 0xFFFF
            if limb:
                parts.append(F.shiftleft(low * F.lit(limb).cast("bigint"), 16 * i))
                if i < 2:
                    parts.append(F.shiftleft(high * F.lit(limb).cast("bigint"), 32 + 16 * i))
        return reduce(add64, parts) if parts else F.lit(0).cast("bigint")

    return let(x, limbs)


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def shifted_xor(x: Column, right: int = 0, left: int = 0) -> Column:
    """x ^ (x >> right), logical, or x ^ (x << left)."""
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, right) if right else F.shiftleft(v, left)))
