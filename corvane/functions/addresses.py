"""Hexadecimal addresses in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = r"^\s*(?:0[xX])?0*([0-9a-fA-F]{1,16})\s*$"


def address(text: Column) -> Column:
    """The address as a 64-bit pattern (signed bigint); null for anything but a hexadecimal number.

    Prefix, case, blanks and leading zeros do not matter.
    """
    digits = F.regexp_extract(text, _HEX, 1)
    return F.when(digits != "", F.conv(digits, 16, -10).cast("bigint"))


def address_text(value: Column) -> Column:
    """``0x`` and lower-case digits without leading zeros."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def unsigned_order(value: Column) -> Column:
    """A bigint that sorts as the unsigned value of ``value`` does."""
    return value.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))
