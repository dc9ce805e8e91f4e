"""Relations of the operators, made from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import address
from ..operators.corpus import operation_token
from ..plans.skew import salted_join
from .tables import current_functions, table

#: Raw operations that the order lines stand for in ``operations``.
RAW = ["COPY", "INT_SUB", "STORE", "LOAD", "INT_ADD", "RETURN", "FLOAT_ADD", "INT_CARRY", "BOOL_AND", "MULTIEQUAL", "CBRANCH", "CALL", "INT_LESS", "INT_EQUAL", "POPCOUNT", "INT_REM"]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(label, fn_id, tokens): lower-cased letter runs of the current bodies."""
    now = current_functions(spark, folder, ["label", "pseudocode"]).filter("pseudocode is not null")
    return now.select("label", "fn_id", F.regexp_extract_all(F.lower("pseudocode"), F.lit("([a-z]+)"), 1).alias("tokens"))


def operations(spark: SparkSession, folder: str) -> DataFrame:
    """(label, fn_id, tokens): operation tokens of each order, one for each of its lines.

    Merged, so that orders of a small file but many rows are not broadcast.
    """
    lines = table(spark, folder, "lineitem")
    name = F.element_at(F.array(*[F.lit(x) for x in RAW]), (F.pmod("l_partkey", F.lit(len(RAW))) + 1).cast("int"))
    size = F.element_at(F.array(F.lit(8), F.lit(8), F.lit(1)), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int"))
    token = operation_token(name, size)
    rows = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", token.alias("token")).alias("r")).filter("r.token is not null")
    grouped = rows.groupBy(F.col("l_orderkey").alias("fn_id")).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["token"]).alias("tokens"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("fn_id"), F.col("o_orderpriority").alias("label"))
    return grouped.join(orders.hint("merge"), "fn_id").select("label", "fn_id", "tokens")


def call_targets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node = fn_id, label, name, size, depth, caller_count, addr) and calls (src, label, addr), repeats kept."""
    now = current_functions(spark, folder, ["label", "va", "name", "size", "called_vas", "depth", "caller_count"])
    nodes = now.select(F.col("fn_id").alias("node"), "label", "name", "size", "depth", "caller_count", address(F.col("va")).alias("addr"))
    calls = now.select(F.col("fn_id").alias("src"), "label", F.explode("called_vas").alias("t")).select("src", "label", address(F.col("t")).alias("addr"))
    return nodes, calls.filter("addr is not null")


def call_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node = fn_id, label, name, size) and call edges (src, dst), repeats kept, targets outside null.

    A function that very many call is a hot key of the calls, so these are salted.
    """
    nodes, calls = call_targets(spark, folder)
    own = nodes.select("label", "addr", F.col("node").alias("dst"))
    return nodes, salted_join(calls, own, ["label", "addr"], F.col("src"), "left").select("src", "dst")


def global_reads(spark: SparkSession, folder: str) -> DataFrame:
    """(label, fn, addr, size) of symbolic runs, each run once."""
    runs = table(spark, folder, "exec_result").filter("global_reads is not null")
    one = runs.groupBy("exec_id").agg(F.max_by(F.struct("label", "global_reads"), F.struct("run_ts", "va")).alias("r"))
    return one.select(F.col("r.label").alias("label"), F.col("exec_id").alias("fn"), F.explode("r.global_reads").alias("addr", "size"))


def first_steps(spark: SparkSession, folder: str) -> DataFrame:
    """(label, var, first_step) of each run: the place of the first constraint that names a variable."""
    named = constraint_rows(spark, folder).select("label", "exec_id", "pos", F.explode("vars").alias("var")).filter("var is not null")
    return named.groupBy("label", "exec_id", "var").agg(F.min("pos").alias("first_step")).select("label", "var", "first_step")


def constraint_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(exec_id, label, addr, op, lhs, rhs_var, rhs_const, vars, is_ambiguous) of each constraint of a run, without copies."""
    runs = table(spark, folder, "exec_result").select("exec_id", "label", F.posexplode("constraints").alias("pos", "c")).filter("c is not null and c.formula is not null")
    flat = runs.select("exec_id", "label", "pos", "c.addr", "c.formula.op", "c.formula.lhs", "c.formula.rhs_var", "c.formula.rhs_const", "c.vars", "c.is_ambiguous", "c.branch_taken")
    return flat.dropDuplicates(["exec_id", "pos"])


def io_map(spark: SparkSession, folder: str) -> DataFrame:
    """(func, x, fx): first argument and result of the calls without error, first write wins."""
    from ..operators.iomap import first_writes

    calls = table(spark, folder, "execute_result").filter("error is null and size(args) > 0")
    probes = calls.select(F.concat_ws("::", "label", "func_id").alias("func"), F.struct("run_ts", "probe_id").alias("seq"), F.get("args", F.lit(0)).alias("x"), F.col("retval").alias("fx"))
    return first_writes(probes)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """(session, addr_key, value, addr, ts, seq) from the event stream."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.pmod("user_id", F.lit(10)).alias("session"), k.alias("addr_key"), F.col("event_type").alias("value"), (k * 1000003 + F.pmod("event_id", F.lit(7)) * 65536).alias("addr"), "ts", F.col("event_id").alias("seq"))


def part_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node = part) and edges from a part to the next of its order."""
    from pyspark.sql.window import Window

    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("dst"))
    nodes = table(spark, folder, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_size", "p_name")
    return nodes, lines.filter("dst is not null").select(F.col("l_partkey").alias("src"), "dst")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded, so that the order of additions does not show."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def upper_label(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))
