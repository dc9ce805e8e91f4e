"""A Bloom filter that is itself a small DataFrame.

Each key picks one 64-bit word and sets four of its bits.  The filter is a table of
words, built by one partial aggregation and probed by a broadcast hash join on the
word's number, so that building and probing stay in generated code.  Its size is
bounded by ``MAX_WORDS`` whatever the number of keys; a fuller filter lets more keys
pass, which costs time but no rows, as callers verify what passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**19 words: a broadcast of some 20 MB in Spark's row format.
MAX_WORDS = 1 << 19
#: Keys a word at about 3 % of false positives.
KEYS_PER_WORD = 5


def words_for(n_keys: int) -> int:
    """A power of two between 64 and MAX_WORDS."""
    want = max(64, min(MAX_WORDS, n_keys // KEYS_PER_WORD + 1))
    return 1 << (want - 1).bit_length()


def _mask(hashed: Column) -> Column:
    """Four bits of a word, from 24 bits of the hash."""
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _keyed(df: DataFrame, columns: list[str], words: int) -> DataFrame:
    """``df`` with the number of the key's word and its mask: the hash's upper bits choose the word, the lower ones the bits."""
    h = df.withColumn("_h", F.xxhash64(*columns))
    return h.withColumn("_word", F.shiftrightunsigned("_h", 24).bitwiseAND(F.lit(words - 1))).withColumn("_mask", _mask(F.col("_h"))).drop("_h")


def build(keys: DataFrame, columns: list[str], n_keys: int) -> tuple[DataFrame, int]:
    """The filter's words and their number, for keys of which there are about ``n_keys``."""
    words = words_for(n_keys)
    return _keyed(keys.select(*columns), columns, words).groupBy("_word").agg(F.bit_or("_mask").alias("_set")), words


def probe(df: DataFrame, columns: list[str], bloom: tuple[DataFrame, int], flag: str) -> DataFrame:
    """``df`` with a Boolean column: false means that the key is certainly absent."""
    table, words = bloom
    joined = _keyed(df, columns, words).join(F.broadcast(table), "_word", "left")
    hit = F.col("_set").bitwiseAND(F.col("_mask")) == F.col("_mask")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_word", "_mask", "_set")
