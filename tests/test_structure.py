"""Nested records, hierarchies and references against brute force and in odd cases."""

import json
import random

from pyspark.sql import functions as F

from corvane.functions.addresses import address, address_text
from corvane.operators import hierarchy as H
from corvane.operators import nested as N
from corvane.operators.orphans import dangling_references
from corvane.plans import bloom
from corvane.plans.skew import salted_join
from corvane.plans.structure_queries import REPORT_FIELDS, REPORT_TABLES, p1_found, p1_tables


def test_addresses(spark):
    rows = [("0x10",), (" 0X0010 ",), ("10",), ("xyz",), (None,), ("",), ("0xffffffffffffffff",), ("0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(address(F.col("t"))).collect()]
    assert got == [16, 16, 16, None, None, None, -1, 0]
    assert spark.range(1).select(address_text(F.lit(-1).cast("bigint")), address_text(F.lit(0).cast("bigint"))).first()[:] == ("0xffffffffffffffff", "0x0")


def shred(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "report_id bigint, payload string")
    return {tuple(r)[:4] for r in N.shred(df, "report_id", "payload", REPORT_FIELDS, REPORT_TABLES).collect()}


def test_report_shapes(spark):
    lone = {"clusters": {"base": 1, "addresses": ["0x10", None, 3]}, "indirect_structs": {"0x10": {"8": [1, 2], "0x9": {"size": 1}}, "32": None}}
    text = {"run": "x", "report": {"clusters": json.dumps([None, {"base": 1, "addresses": None}]), "indirect_structs": {}}}
    got = shred(spark, [json.dumps(lone), json.dumps(text), "", None, "{\"clusters\": [", json.dumps({"clusters": None}), json.dumps({"clusters": [5, {"addresses": 7}]})])
    assert got == {
        ("cluster", 0, 0, -1), ("cluster_address", 0, 0, 0), ("cluster_address", 0, 0, 2), ("indirect_base", 0, 16, -1), ("indirect_field", 0, 16, 8), ("indirect_field", 0, 16, 9), ("indirect_base", 0, 32, -1),
        ("cluster", 1, 1, -1), ("cluster", 6, 0, -1), ("cluster", 6, 1, -1), ("cluster_address", 6, 1, 0),
    }


def test_latest_readable_and_empty(spark):
    rows = [(1, "2026-01-01 00:00:00", '{"clusters": []}'), (1, "2026-01-02 00:00:00", "{"), (2, None, '{"clusters": [1]}'), (3, "2026-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "report_id bigint, run_ts string, payload string").withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    got = {r[0]: r[1] for r in N.latest_readable(df, "report_id", "run_ts", "payload", REPORT_FIELDS).collect()}
    assert got == {1: '{"clusters": []}', 2: '{"clusters": [1]}'}
    assert N.latest_readable(df.limit(0), "report_id", "run_ts", "payload", REPORT_FIELDS).count() == 0


def test_typed_arrays_and_plan(spark):
    df = spark.createDataFrame([(1, [{"v": ["a", None], "x": 1}, None]), (2, None), (3, [])], "id bigint, cs array<struct<v: array<string>, x: int>>")
    got = {tuple(r)[:4] for r in N.explode_typed(df, "id", "cs", "c", {"v": "cv"}).collect()}
    assert got == {("c", 1, 0, -1), ("cv", 1, 0, 0)}
    plan = N.inlining(N.type_graph(df.schema["cs"].dataType))
    assert plan["$.v" if "$.v" in plan else "$[].v"]["parent"] == "$"
    graph = {(r["path"], r["kind"]) for r in N.schema_graph(spark.createDataFrame([('{"a": {"b": [1]}}',), ("x",)], "t string"), "t").collect()}
    assert ("$.a.b", "list") in graph and ("$", "unreadable") in graph


def reference(nodes, edges):
    adj = {v: {w for u, w in edges if u == v} for v in nodes}
    reach = {}
    for v in nodes:
        seen, q = {v: 0}, [v]
        for x in q:
            for w in sorted(adj[x]):
                if w not in seen:
                    seen[w] = seen[x] + 1
                    q.append(w)
        reach[v] = seen
    cyc = {v: int(any(v in reach[w] for w in adj[v])) for v in nodes}
    out = set()
    for r in nodes:
        grp = {w for w in reach[r] if r in reach[w]}
        if r == min(grp) and not any(w in grp and u not in grp for u, w in edges):
            out |= {(r, v, d, cyc[v]) for v, d in reach[r].items()}
    return out, adj


def frames(spark, nodes, edges, grp="g"):
    n = spark.createDataFrame([(grp, v, v) for v in nodes], "grp string, id bigint, key bigint")
    e = spark.createDataFrame([(grp, u, v, u, v) for u, v in edges], "grp string, src bigint, dst bigint, u bigint, v bigint")
    return n, e


def test_hierarchy_both_ways(spark):
    rng = random.Random(5)
    nodes = list(range(40))
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(38)] + [(0, 0), (1, 2), (1, 2)]
    want, adj = reference(nodes, edges)
    for limit in (10_000, 0):  # in packed tasks, and distributed
        rows = H.hierarchy(*frames(spark, nodes, edges), local_rows=limit).collect()
        assert {(r["root"], r["node"], r["depth"], r["on_cycle"]) for r in rows} == want
        by = {(r["root"], r["node"]): r for r in rows}
        for r in rows:
            if r["parent"] is not None:
                assert r["node"] in adj[r["parent"]] and by[r["root"], r["parent"]]["depth"] == r["depth"] - 1
                p = by[r["root"], r["parent"]]
                assert p["pre"] < r["pre"] and r["last"] <= p["last"]
            below = [x for x in rows if x["root"] == r["root"] and r["pre"] <= x["pre"] <= r["last"]]
            assert len(below) == r["last"] - r["pre"] + 1
    paths = H.paths(H.hierarchy(*frames(spark, nodes, edges))).collect()
    for r in paths:
        assert r["path"][0] == r["root"] and r["path"][-1] == r["node"] and len(r["path"]) == r["depth"] + 1
        assert all(b in adj[a] for a, b in zip(r["path"], r["path"][1:], strict=False))


def test_hierarchy_empty_and_unsigned(spark):
    n, e = frames(spark, [], [])
    assert H.hierarchy(n, e).count() == 0
    n, e = frames(spark, [-5, 3], [(-5, 3), (3, -5)])  # -5 is the greater address
    assert {r["root"] for r in H.hierarchy(n, e).collect()} == {3}


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100)]
    got = {r["node"]: r["comp"] for r in H.star_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(1000).select(F.col("id").alias("k"))
    made = bloom.build(keys, ["k"], 1000)
    probed = bloom.probe(spark.range(3000).select(F.col("id").alias("k")), ["k"], made, "hit").groupBy((F.col("k") < 1000).alias("own")).agg(F.avg(F.col("hit").cast("double")).alias("r")).collect()
    rate = {r["own"]: r["r"] for r in probed}
    assert rate[True] == 1.0 and rate[False] < 0.2


def test_salted_join(spark):
    left = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = salted_join(left, right, ["k"], F.col("v"), threshold=50, salts=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_dangling(spark):
    day = lambda df, *c: df.withColumns({x: F.col(x).cast("date") for x in c})
    refs = day(spark.createDataFrame([("t", "a", "k1", 1, "2026-01-05"), ("t", "a", "k1", 2, "2026-01-05"), ("t", "a", "k2", 3, "2026-01-05"), ("t", "a", "k2", 3, "2026-01-05"), ("t", "a", "k3", 4, "2026-01-05"), ("t", None, "k4", 1, "2026-01-05"), ("t", "a", "k5", 9, None)], "ref_table string, label string, ref_key string, target bigint, period string"), "period")
    parents = day(spark.createDataFrame([("a", 1, "2026-01-01"), ("a", 2, "2026-01-09"), ("a", 3, "2026-01-01"), ("a", 2, "2026-01-08")], "label string, target bigint, day string"), "day")
    gone = day(spark.createDataFrame([("a", 3, "2026-01-05"), ("a", 1, "2026-01-06")], "label string, target bigint, day string"), "day")
    got = {(r["ref_key"], r["target"], r["state"]) for r in dangling_references(refs, parents, gone, ["label", "target"]).collect()}
    assert got == {("k1", 2, "late"), ("k2", 3, "deleted"), ("k3", 4, "missing"), ("k5", 9, "missing")}
    assert dangling_references(refs, parents.limit(0), gone.limit(0), ["label", "target"]).filter("state != 'missing'").count() == 0


def test_tables_come_from_the_schema_graph(spark, tmp_path):
    cluster = {"base": 1, "addresses": [1], "offsets": [0, None, 4], "hub_globals": [9], "loc": {"x": 1}}
    report = {"n_globals": 2, "dominant_type": None, "clusters": [cluster], "indirect_structs": {"16": {"8": [4, 2], "12": {"size": 4, "fn_count": 2}}}, "loc": {"x": 2}, "extra": {"deep": [{"more": [7]}]}, "node": {"v": 1, "node": {"v": 2, "node": {"v": 3}}}}
    spark.createDataFrame([(1, "2026-01-01", json.dumps(report))], "report_id bigint, run_ts string, payload string").withColumn("run_ts", F.col("run_ts").cast("timestamp")).write.parquet(f"{tmp_path}/geometry_report.parquet")
    spark.createDataFrame([(5, [{"addr": 3, "vars": ["a"], "marks": [6]}])], "exec_id bigint, constraints array<struct<addr: bigint, vars: array<string>, marks: array<int>>>").write.parquet(f"{tmp_path}/exec_result.parquet")
    rows = p1_tables(spark, str(tmp_path)).collect()
    got = {(r["rel"], r["parent_id"], r["k1"], r["k2"], *r["rest"]): r["columns"] and json.loads(r["columns"]) for r in rows}
    assert got == {
        ("record", 1, -1, -1): {"n_globals": 2, "dominant_type": None, "extra": {}, "node": {"v": 1}}, ("loc", 1, 0, -1): {"x": 2}, ("cluster_loc", 1, 0, 0): {"x": 1},
        ("cluster", 1, 0, -1): {"base": 1}, ("cluster_address", 1, 0, 0): 1, ("cluster_offsets", 1, 0, 0): 0, ("cluster_offsets", 1, 0, 2): 4, ("cluster_hub_globals", 1, 0, 0): 9,
        ("indirect_base", 1, 16, -1): None, ("indirect_field", 1, 16, 8): [4, 2], ("indirect_field", 1, 16, 12): {"size": 4, "fn_count": 2},
        ("extra_deep", 1, 0, -1): None, ("extra_deep_more", 1, 0, 0): 7, ("node_node", 1, 0, -1): {"v": 2}, ("node_node", 1, 0, 0): {"v": 3},
        ("constraint", 5, 0, -1): {"addr": 3}, ("constraint_var", 5, 0, 0): {"value": "a"}, ("constraint_marks", 5, 0, 0): {"value": 6},
    }
    assert {r["rel"] for r in p1_found(spark, str(tmp_path)).collect()} == {"cluster", "cluster_address", "indirect_base", "indirect_field", "constraint", "constraint_var"}
