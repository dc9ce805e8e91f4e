"""Token corpora: vocabularies, frequencies, entropy and rewrites.

A corpus has one row per function: ``label``, ``fn_id``, ``tokens``; tokens keep order
and repeats.  Rows with null tokens count as empty; null tokens are no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import entropy_of
from ..plans.numbering import numbered

# Operation names that are dropped, and those that are merged.
DROPPED = ["MULTIEQUAL", "INDIRECT", "CAST", "SEGMENTOP", "CPOOLREF", "NEW", "IMARK"]
MERGED = {
    "FLOAT_ARITH": "FLOAT_ADD FLOAT_SUB FLOAT_MULT FLOAT_DIV FLOAT_SQRT FLOAT_NEG FLOAT_ABS FLOAT_CEIL FLOAT_FLOOR FLOAT_ROUND",
    "FLOAT_CMP": "FLOAT_EQUAL FLOAT_NOTEQUAL FLOAT_LESS FLOAT_LESSEQUAL FLOAT_NAN",
    "FLOAT_CAST": "FLOAT_INT2FLOAT FLOAT_FLOAT2FLOAT FLOAT_TRUNC",
    "OVERFLOW_CHECK": "INT_CARRY INT_SCARRY INT_SBORROW",
    "INT_UCMP": "INT_LESS INT_LESSEQUAL",
    "INT_SCMP": "INT_SLESS INT_SLESSEQUAL",
    "INT_DIVIDE": "INT_DIV INT_SDIV",
    "INT_MODULO": "INT_REM INT_SREM",
    "BOOL_OP": "BOOL_AND BOOL_OR BOOL_XOR BOOL_NEGATE",
}
UNSIZED = ["BRANCH", "CBRANCH", "BRANCHIND", "CALL", "CALLIND", "CALLOTHER", "RETURN"]


def operation_token(name: Column, size: Column) -> Column:
    """The token of a raw operation, or null where it is dropped."""
    merged = F.create_map(*[F.lit(x) for to, names in MERGED.items() for n in names.split() for x in (n, to)])
    base = F.coalesce(F.try_element_at(merged, name), name)
    sized = F.when(base.isin(UNSIZED) | (F.coalesce(size, F.lit(0)) <= 0), base).otherwise(F.concat_ws("_", base, size.cast("string")))
    return F.when(name.isin(DROPPED) | ((name == "POPCOUNT") & (size == 1)), None).otherwise(sized)


def rewritten(tokens: Column) -> Column:
    """Frame set-up and tear-down as one token each, overflow checks removed."""
    text = F.array_join(F.array_remove(tokens, "OVERFLOW_CHECK_1"), " ")
    text = F.regexp_replace(text, r"^(COPY_8 )*INT_SUB_8 STORE_[^ ]+( |$)", "__PROLOGUE__ ")
    text = F.trim(F.regexp_replace(text, r"(^| )LOAD_8 INT_ADD_8 RETURN$", " __EPILOGUE__"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def exploded(corpus: DataFrame) -> DataFrame:
    return corpus.select("label", "fn_id", F.explode("tokens").alias("token")).filter("token is not null")


def vocabulary(corpus: DataFrame) -> DataFrame:
    """(idx, token, n): every token with its count and its place in ascending order."""
    counts = exploded(corpus).groupBy("token").agg(F.count("*").alias("n"))
    return numbered(counts, [F.col("token")], "idx").select("idx", "token", "n")


def term_frequency(corpus: DataFrame) -> DataFrame:
    """(fn_id, token, tf, l1): counts and counts over the function's sum."""
    counts = exploded(corpus).groupBy("fn_id", "token").agg(F.count("*").alias("tf"))
    total = F.sum("tf").over(Window.partitionBy("fn_id"))
    return counts.withColumn("l1", F.col("tf") / total)


def diversity(corpus: DataFrame) -> DataFrame:
    """(label, n_unique, n_total, entropy) of each label's token stream."""
    counts = exploded(corpus).groupBy("label", "token").agg(F.count("*").alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "label").withColumn("p", F.col("n") / F.col("total"))
    return share.groupBy("label").agg(F.count("*").alias("n_unique"), F.max("total").alias("n_total"), entropy_of(F.col("p")).alias("entropy"))


def size_guard(functions: DataFrame, low: int = 4, high: int = 8000) -> DataFrame:
    """Functions of a plausible size that have tokens."""
    return functions.filter(F.col("size").between(low, high) & (F.size("tokens") > 0))


def removed_overflow(corpus: DataFrame) -> DataFrame:
    """(label, removed, n_tokens): how many overflow checks the rewrite takes out."""
    gone = F.size("tokens") - F.size(F.array_remove("tokens", "OVERFLOW_CHECK_1"))
    return corpus.groupBy("label").agg(F.sum(gone).alias("removed"), F.sum(F.size("tokens")).alias("n_tokens"))
