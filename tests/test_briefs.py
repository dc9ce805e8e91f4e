"""Annotations, briefs, reference functions and rankings on small inputs."""

import zlib

from pyspark.sql import functions as F

from corvane.operators import annotate as A
from corvane.operators import briefs as B
from corvane.operators import graph as G
from corvane.operators import iomap as M


def test_reference_functions(spark):
    m32, m64 = 2**32 - 1, 2**64 - 1

    def crc_step(x):
        # the running value of zlib is inverted at both ends
        return zlib.crc32(b"\0", (x & m32) ^ m32) ^ m32

    def pcg(x):
        w, t = (((x >> 18) ^ x) >> 27) & m32, x >> 59
        return ((w >> t) | (w << (32 - t))) & m32

    def adler(x):
        a = (x & 0xFFFF) % 65521
        return (((x >> 16 & 0xFFFF) + a) % 65521) << 16 | a

    want = {"crc32_ieee": crc_step, "pcg32_output": pcg, "adler32_step": adler, "djb2_add": lambda x: x * 33 & m64, "fnv1a_32": lambda x: x * 0x01000193 & m32, "lcg_glibc": lambda x: (x * 1103515245 + 12345) & m32}
    xs = [0, 1, 255, 70000, 2**31 + 5, 2**40 + 12345, 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x bigint")
    rows = df.select("x", *[f(F.col("x")).alias(n) for n, f in M.REFERENCE_FUNCTIONS.items()]).collect()
    for r in rows:
        for name, f in want.items():
            x = r["x"] & m32 if name == "crc32_ieee" and r["x"] <= m32 else r["x"]
            if name == "crc32_ieee" and r["x"] > m32:
                continue
            assert r[name] & m64 == f(x), (name, r["x"])
    # each registered function finds itself
    io = None
    for n, f in M.REFERENCE_FUNCTIONS.items():
        part = spark.range(1, 300).select(F.lit(n).alias("func"), (F.col("id") * 2654435761).alias("x")).withColumn("fx", f(F.col("x")))
        io = part if io is None else io.unionByName(part)
    best = {r["func"]: r["vector"] for r in M.best_match(M.reference_matches(io), list(M.REFERENCE_FUNCTIONS)).collect()}
    same = {"pcg32_step": "pcg32_output", "djb2_xor": "djb2_add"}
    assert best == {n: same.get(n, n) for n in M.REFERENCE_FUNCTIONS}


def test_annotations(spark):
    text = "int f(int a, void (*g)(int, int), char b)\n{ if (a == 0x0A) return *(int *)(a + 0x18); g(0xFF, (1, 2), a); }"
    df = spark.createDataFrame([(1, text), (2, "f(void) {}"), (3, None), (4, ""), (5, "no parenthesis")], "id bigint, t string")
    assert [r[0] for r in df.orderBy("id").select(A.argument_count(F.col("t"))).collect()] == [3, 0, None, 1, 1]
    noted = df.filter("id = 1").select(A.field_notes(F.col("t"), {0x18: "next"}).alias("f"), A.comparison_notes(F.col("t"), {10: "TEN"}).alias("c"), A.sentinel_notes(F.col("t"), {"0xff": "ALL"}).alias("s")).first()
    assert "a + 0x18 /* ->next */)" in noted["f"] and "== 0x0A /* TEN */)" in noted["c"] and "g(0xff /* ALL */, (1" in noted["s"]
    again = spark.createDataFrame([tuple(noted)], "f string, c string, s string").select(A.field_notes(F.col("f"), {0x18: "next"}), A.comparison_notes(F.col("c"), {10: "TEN"}), A.sentinel_notes(F.col("s"), {"0xff": "ALL"})).first()
    assert tuple(again) == tuple(noted)
    args = {(r["callee"], r["call"], r["position"]): (r["argument"], r["value"]) for r in A.call_arguments(df, "id", "t", ["g", "f"]).filter("id = 1").collect()}
    assert args[("g", 0 if ("g", 0, 0) in args else 1, 0)] == ("0xFF", 255) and ("(1, 2)", None) in args.values()
    names = spark.createDataFrame([("g", 0, 255, "ALL"), ("g", 0, 255, "ANY"), ("g", 2, 1, "x")], "callee string, position int, value bigint, name string")
    assert [r["name"] for r in A.named_arguments(A.call_arguments(df, "id", "t", ["g"]), names).collect()] == ["ALL"]
    assert A.call_arguments(df.limit(0), "id", "t", ["g"]).count() == 0


def test_answers(spark):
    rows = [(1, '```json\n[{"va": "0x1", "understanding": 7}, {"name": "x"}]\n```'), (2, '{"functions": [{"va": "0x2", "understanding": "bad"}], "observations": []}'), (3, '{"va": "0x3", "understanding": 0.25, "is_runtime": true}'), (4, "no json"), (5, None), (6, "")]
    got = {r["id"]: (r["va"], r["understanding"], r["is_runtime"]) for r in A.answer_items(spark.createDataFrame(rows, "id int, t string"), "t", 2).collect()}
    assert got == {1: ("0x1", 1.0, False), 2: ("0x2", 0.5, False), 3: ("0x3", 0.25, True)}


def test_briefs(spark):
    names = spark.createDataFrame([(-1,), (0,), (7,), (None,)], "c int").select(B.cluster_name(F.col("c"), {0: "GETTER"})).collect()
    assert [r[0] for r in names] == ["NOISE", "GETTER", "C7", None]
    members = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (0, "b", 3), (1, "b", 4)], "c int, label string, fn_id bigint")
    present = spark.createDataFrame([(1, 0), (2, 0), (4, 1)], "fn_id bigint, rule_id int")
    got = {(r["c"], r["kind"], r["rank"]): (r["item"], r["value"]) for r in B.cluster_profile(members, present, "c").collect()}
    assert got[0, "size", 1] == ("n", 3.0) and got[0, "binary", 1] == ("a", 2.0) and got[0, "rule", 1] == ("0", round(2 / 3 - 0.5, 6)) and got[1, "rule", 1] == ("1", 0.75) and got[0, "example", 3] == ("3", None)
    packet = B.bands(members.withColumn("band", F.lit("x")), ["c"], "band", [F.col("fn_id")], {"x": 2})
    assert sorted(r["fn_id"] for r in packet.collect()) == [1, 2, 4]
    values = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "label string, m double")
    assert [tuple(r) for r in B.comparison(values, "label", ["m"]).collect()] == [("m", 1.0, 3.0, 2.0, "a", "b")]


def test_noise_and_utility(spark):
    fns = spark.createDataFrame([(1, "x", ["memset", "FUN_1"]), (2, "x", ["memset"]), (3, "x", ["rare"]), (4, "x", None)], "fn_id bigint, label string, named_callees array<string>")
    dist = spark.createDataFrame([(1, 0), (2, 1), (3, -1), (4, 2)], "node bigint, dist int")
    assert {r["node"]: (r["unreachable"], r["common_only"]) for r in G.noise(fns, dist).collect()} == {1: (False, True), 2: (False, True), 3: (True, False), 4: (False, False)}
    nodes = spark.createDataFrame([(1, 0, "p", 0), (2, 0, "q", 1), (3, 0, "q", None)], "node bigint, comp bigint, kind string, n_in int")
    edges = spark.createDataFrame([(1, 2), (3, 2)], "src bigint, dst bigint")
    got = {r["node"]: round(r["utility"], 4) for r in G.utility(nodes, edges, "comp", "kind", "n_in").collect()}
    assert got[1] == 0 and got[3] == 0 and got[2] == round(0.3 + 0.4 * 0.5 + 0.3, 4)
