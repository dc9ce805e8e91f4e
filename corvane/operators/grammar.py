"""Grammars from token streams by replacing the most frequent pair, round by round.

Stands in for the online grammar of the original method, which reads one stream in
order and can't be split; only the set of terminals of each rule is used downstream.
Each round counts neighbouring pairs over all functions, makes a rule of each
frequent one, and replaces pairs in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def mine(corpus: DataFrame, rules: int = 300, per_round: int = 20, least: int = 2) -> DataFrame:
    """(rule_id, count, expansion): rules in the order they were made, expanded to tokens, until ``rules`` are made or no pair recurs.

    ``per_round`` pairs are replaced in a round, most frequent first, ties by text; a
    rule counts its uses when it was made.  Functions are separate streams.
    """
    spark = corpus.sparkSession
    stream = cut(corpus.filter(F.size("tokens") > 0).select("fn_id", F.array_join("tokens", " ").alias("t")))
    expansion: dict[str, list[str]] = {}
    made: list[tuple[int, int, list[str]]] = []
    while len(made) < rules:
        tokens = F.split("t", " ")
        pairs = stream.filter(F.size(tokens) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.array_join(F.slice(tokens, i, 2), " "))).alias("p"))
        top = pairs.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "p").limit(min(per_round, rules - len(made))).collect()
        if not top:
            break
        text = F.concat(F.lit(" "), F.regexp_replace("t", " ", "  "), F.lit(" "))
        for r in top:
            a, b = r["p"].split(" ")
            name = f"~{len(made)}"
            expansion[name] = [x for part in (a, b) for x in expansion.get(part, [part])]
            made.append((len(made), r["n"], expansion[name]))
            text = F.regexp_replace(text, rf" {_quoted(a)}  {_quoted(b)} ", f" {name} ")
        stream = cut(stream.select("fn_id", F.trim(F.regexp_replace(text, " +", " ")).alias("t")), stream)
    return spark.createDataFrame(made, "rule_id int, count bigint, expansion array<string>")


def _quoted(token: str) -> str:
    import re

    return re.escape(token)


def kept(rules: DataFrame, top: int = 300) -> DataFrame:
    """Rules of at least two tokens, most used first, ties to the later one; the size of the grammar is a parameter."""
    return rules.filter(F.size("expansion") >= 2).orderBy(F.desc("count"), F.desc("rule_id")).limit(top)
