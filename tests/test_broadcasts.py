"""What joins send to the driver stays as small as the rules, whatever the functions."""

from pyspark.sql import functions as F

from corvane.operators import briefs as B
from corvane.operators import patterns as P
from corvane.plans.lineage import cut
from corvane.sources.relations import operations


def nodes(df):
    """(kind, node) of a plan that has run, as Spark ended with it; what is reused counts once."""

    def walk(p):
        kind = p.getClass().getSimpleName()
        yield kind, p
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from walk(p.plan())
        children = p.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def broadcast_rows(df):
    """Rows of the largest broadcast."""
    return max((p.metrics().apply("numOutputRows").value() for kind, p in nodes(df) if kind == "BroadcastExchangeExec"), default=0)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def functions(spark, n):
    """Functions of two tokens in a row, some of one more, in a small file."""
    tokens = F.array(F.lit("A"), F.when(F.col("id") % 2 == 0, "B").otherwise("C"), F.when(F.col("id") % 10 == 0, "D").otherwise("A"))
    return cut(spark.range(n).select(F.when(F.col("id") % 4 < 3, "x").otherwise("y").alias("label"), F.col("id").alias("fn_id"), tokens.alias("tokens")))


def test_presence_broadcasts_rules_only(spark):
    ops, rules = functions(spark, 2000), cut(spark.createDataFrame([(0, ["A", "B"]), (1, ["A", "C"]), (2, ["D", "B"]), (3, ["A", "E"])], "rule_id int, expansion array<string>"))
    present = P.presence(ops, rules)
    got = {}
    for r in present.collect():
        got.setdefault(r["rule_id"], []).append(r["fn_id"])
    assert {k: sorted(v) for k, v in got.items()} == {0: list(range(0, 2000, 2)), 1: list(range(1, 2000, 2)), 2: list(range(0, 2000, 10))}
    assert 0 < broadcast_rows(present) <= 8


def test_operations_broadcast_no_orders(spark, tmp_path):
    lines = spark.range(900).select((F.col("id") / 3).cast("bigint").alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), F.lit(0).cast("bigint").alias("l_partkey"), F.lit(0).cast("bigint").alias("l_suppkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(400).select(F.col("id").alias("o_orderkey"), F.lit("x").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    ops = operations(spark, str(tmp_path))
    assert [(r["fn_id"], r["tokens"]) for r in sorted(ops.collect(), key=lambda r: r["fn_id"])] == [(i, ["COPY_8"] * 3) for i in range(300)]
    assert broadcast_rows(ops) == 0


def test_lift_counts_what_is_present_once(spark):
    ops, rules = functions(spark, 2000), cut(spark.createDataFrame([(0, ["A", "B"]), (1, ["A", "C"]), (2, ["D", "B"])], "rule_id int, expansion array<string>"))
    lift = P.lift(P.presence(ops, rules), ops, "label").select("label", "rule_id", F.round("local", 6), F.round("overall", 6), F.round("lift", 6))
    # y has the 500 whose number leaves 3 when divided by 4, so odd ones only
    want = {("x", 0, 0.666667, 0.5, 0.166667), ("x", 1, 0.333333, 0.5, -0.166667), ("y", 1, 1.0, 0.5, 0.5), ("x", 2, 0.133333, 0.1, 0.033333)}
    assert rows_of(lift) == want
    assert broadcast_rows(lift) <= 8
    present = cut(P.presence(ops, rules))
    lift = P.lift(present, ops, "label")
    lift.collect()
    read = [p for kind, p in nodes(lift) if kind == "FileSourceScanExec" and "rule_id" in p.output().toString()]
    assert len(read) == 1


def test_lift_without_label_counts_overall(spark):
    ops = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), ("y", 4)], "label string, fn_id bigint")
    present = spark.createDataFrame([("x", 1, 0), (None, 3, 0), (None, 3, 1), ("y", 4, 1)], "label string, fn_id bigint, rule_id int")
    assert rows_of(P.lift(present, ops, "label")) == {("x", 0, 0.5, 0.5, 0.0), ("y", 1, 1.0, 0.5, 0.5)}
    assert rows_of(P.lift(present.limit(0), ops, "label")) == set()


def test_cluster_profile_broadcasts_no_members(spark):
    ops, rules = functions(spark, 2000), cut(spark.createDataFrame([(0, ["A", "B"]), (1, ["A", "C"]), (2, ["D", "B"])], "rule_id int, expansion array<string>"))
    cluster = F.when(F.col("fn_id") < 400, 1).when(F.col("fn_id") < 2000 - 4, 2)
    members, present = cut(ops.select("label", "fn_id", cluster.alias("c"))), cut(P.presence(ops, rules))
    profile = B.cluster_profile(members, present, "c")
    got = {(r["c"], r["kind"], r["rank"]): (r["item"], r["value"]) for r in profile.collect()}
    assert {k[2]: v for k, v in got.items() if k[:2] == (1, "rule")} == {1: ("0", 0.0), 2: ("1", 0.0), 3: ("2", 0.0)}
    # 160 of the 1596 of the cluster 2 have the rule 2, and 200 of all; the cluster null has no lift
    assert {k[2]: v for k, v in got.items() if k[:2] == (2, "rule")} == {1: ("2", round(160 / 1596 - 0.1, 6)), 2: ("0", 0.0), 3: ("1", 0.0)}
    assert [got[None, "size", 1], got[None, "binary", 1], got[None, "example", 1]] == [("n", 4.0), ("x", 3.0), ("1996", None)] and (None, "rule", 1) not in got
    assert 0 < broadcast_rows(profile) <= 8
    read = [p for kind, p in nodes(profile) if kind == "FileSourceScanExec" and "rule_id" in p.output().toString()]
    assert len(read) == 1
