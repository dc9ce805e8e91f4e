"""Small cases of the operators for the reference's own computations."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvane.functions import exprs
from corvane.operators import corpus as C
from corvane.operators import evidence as E
from corvane.operators import graph as G
from corvane.operators import grammar, spectral
from corvane.operators import incidence as I
from corvane.operators import iomap as M
from corvane.operators import patterns as P
from corvane.operators import textfeat as X
from corvane.operators.density import labels_of
from corvane.streaming import monitor


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wrapping_arithmetic(spark):
    xs, cs = (0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567), (1, 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF, 65599)
    df = spark.createDataFrame([(x,) for x in xs], "x bigint")
    both = [f for c in cs for f in (exprs.mul64(F.col("x"), c), exprs.add64(F.col("x"), F.lit(c - 2**64 if c >= 2**63 else c).cast("bigint")))]
    for x, got in zip(xs, df.select(*both).collect(), strict=True):
        assert [v % 2**64 for v in got] == [v for c in cs for v in (x * c % 2**64, (x + c) % 2**64)]


def test_reference_functions(spark):
    def splitmix(x):
        z = (x + 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    got = spark.range(20).select("id", M.REFERENCE_FUNCTIONS["splitmix64"](F.col("id")).alias("f")).collect()
    assert all(r["f"] % 2**64 == splitmix(r["id"]) for r in got)
    h = one(spark, M.REFERENCE_FUNCTIONS["murmur3_fmix32"](F.lit(1).cast("bigint")))[0]
    assert h == 0x514E28B7  # the published finaliser of 1


def test_operation_tokens(spark):
    rows = [("FLOAT_ADD", 8), ("INT_CARRY", 1), ("CALL", 8), ("POPCOUNT", 1), ("CAST", 4), ("COPY", 0), ("COPY", None), (None, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, s int").select(C.operation_token(F.col("n"), F.col("s"))).collect()]
    assert got[:7] == ["FLOAT_ARITH_8", "OVERFLOW_CHECK_1", "CALL", None, None, "COPY", "COPY"]


def test_rewrites(spark):
    rows = [(["COPY_8", "COPY_8", "INT_SUB_8", "STORE_8", "X", "OVERFLOW_CHECK_1", "LOAD_8", "INT_ADD_8", "RETURN"],), ([],), (["OVERFLOW_CHECK_1"],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(C.rewritten(F.col("t"))).collect()]
    assert got[:3] == [["__PROLOGUE__", "X", "__EPILOGUE__"], [], []]


def test_containment_both_ways(spark):
    corpus = spark.createDataFrame([("l", i, t) for i, t in enumerate([["a", "b", "c"], ["a"], [], ["c", "b", "b"]])], "label string, fn_id bigint, tokens array<string>")
    rules = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"]), (2, ["c", "c"])], "rule_id int, expansion array<string>")
    want = {(0, 0), (0, 1), (0, 2), (3, 1), (3, 2)}
    assert {(r["fn_id"], r["rule_id"]) for r in P.presence(corpus, rules).collect()} == want


def test_entropy_and_empty(spark):
    corpus = spark.createDataFrame([("l", 1, ["a", "b", None]), ("l", 2, ["a", "b"]), ("m", 3, None)], "label string, fn_id bigint, tokens array<string>")
    r = C.diversity(corpus).collect()
    assert [(x["label"], x["n_unique"], x["n_total"], x["entropy"]) for x in r] == [("l", 2, 4, 1.0)]
    assert C.vocabulary(corpus.limit(0)).count() == 0


def graph(spark, n, edges):
    return spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "src bigint, dst bigint")


def test_core_is_the_true_one(spark):
    nodes, edges = graph(spark, 6, [(0, 1), (0, 3), (0, 4), (1, 3), (2, 4)])
    got = {r["node"]: r["core"] for r in G.k_core(nodes, edges).collect()}
    assert got == {0: 2, 1: 2, 3: 2, 2: 1, 4: 1, 5: 0}


def test_walks(spark):
    nodes, edges = graph(spark, 6, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 3)])
    assert {r["node"]: r["dist"] for r in G.distances(nodes, edges, nodes.filter("node = 0")).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: -1, 5: -1}
    assert {r["node"]: r["comp"] for r in G.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}
    from corvane.operators.hierarchy import strong_groups

    groups = strong_groups(nodes.select("node", F.col("node").alias("ord")), edges)
    assert {r["node"]: r["scc"] for r in groups.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert {r["scc"]: r["rank"] for r in G.condensation_rank(groups, edges).collect()} == {0: 0, 3: 1, 4: 0, 5: 0}
    pr = {r["node"]: r["rank"] for r in G.pagerank(nodes, edges).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-6 and pr[3] == max(pr.values())
    h = G.hits(nodes, edges).agg(F.sum("hub"), F.sum("authority")).first()
    assert abs(h[0] - 1) < 1e-6 and abs(h[1] - 1) < 1e-6


def test_betweenness(spark):
    nodes, edges = graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    got = {r["node"]: round(r["betweenness"], 6) for r in G.betweenness(nodes, edges).collect()}
    assert got == {0: 0, 1: round(2 / 6, 6), 2: round(2 / 6, 6), 3: 0}


def test_clustering(spark):
    nodes, edges = graph(spark, 5, [(0, 1), (1, 2), (2, 0), (0, 3), (1, 0), (4, 4)])
    got = {r["node"]: (r["triangles"], round(r["cc"], 4)) for r in G.clustering(nodes, edges).collect()}
    assert got == {0: (1, round(1 / 3, 4)), 1: (1, 1), 2: (1, 1), 3: (0, 0), 4: (0, 0)}


def test_metrics_of_maps(spark):
    io = spark.createDataFrame([("id", x, x) for x in range(64)] + [("k", x, 7) for x in range(64)], "func string, x bigint, fx bigint")
    m = {r["func"]: r for r in M.metrics(io).withColumn("c", M.function_class()).collect()}
    assert m["id"]["c"]["func_class"] == "identity" and m["k"]["c"]["func_class"] == "constant"
    assert m["id"]["add_linear"] == 1.0 and m["id"]["inc"] == 1.0 and m["k"]["avalanche"] == 0.0
    assert m["id"]["anf_degree"] == 1 and m["k"]["anf_degree"] == 0
    p = spark.createDataFrame([("f", 2, 1, 5), ("f", 1, 1, 4), ("f", 3, None, 4), (None, 1, 1, 1)], "func string, seq int, x bigint, fx bigint")
    assert [tuple(r) for r in M.first_writes(p).collect()] == [("f", 1, 4)]


def test_gap_clusters_across_blocks(spark):
    edge = 2**32
    a = [1, 100, 5000, edge - 10, edge + 10, 3 * edge]
    want = {1: (0, 0), 100: (0, 99), 5000: (1, 0), edge - 10: (2, 0), edge + 10: (2, 20), 3 * edge: (3, 0)}
    df = spark.createDataFrame([("x", x) for x in [*a, 1]] + [("y", 50)], "label string, addr bigint")
    for bits in (8, 20, 32):
        got = {(r["label"], r["addr"]): (r["cluster"], r["offset"]) for r in I.gap_clusters(df, block_bits=bits).collect()}
        assert got == {("x", k): v for k, v in want.items()} | {("y", 50): (0, 0)}


def test_co_access_in_blocks(spark, monkeypatch):
    rows = [("x", f, a) for f in range(3) for a in range(f, 12)] + [("y", 0, 1), ("y", 0, 2)]
    df = spark.createDataFrame(rows, "label string, fn int, addr bigint")
    want = {("x", a, b): sum(f <= a for f in range(3)) for a in range(12) for b in range(a + 1, 12)} | {("y", 1, 2): 1}
    for block in (1_000, 2):
        monkeypatch.setattr(I, "PAIR_BLOCK", block)
        assert {(r["label"], r["a"], r["b"]): r["weight"] for r in I.co_access(df).collect()} == want


def test_strides(spark):
    c = spark.createDataFrame([("b", 0, o) for o in (0, 8, 16, 24, 40)], "label string, cluster bigint, offset bigint")
    assert tuple(I.modal_stride(c).first()) == ("b", 0, 8, 1.0, 6)
    assert I.gcd_stride(c).first()["gcd"] == 8


def test_runs(spark):
    f = spark.createDataFrame([("b", x) for x in (1, 2, 9, 30, 38)], "k string, at bigint")
    assert {(r["start"], r["end"]) for r in I.change_runs(f, ["k"], "at").collect()} == {(1, 9), (30, 38)}
    s = spark.createDataFrame([("t", i, v, v is not None and v >= 10) for i, v in enumerate([11, 12, 5, 13, 5, 5, 5, 14])], "k string, i int, v bigint, ok boolean")
    assert [r["v"] for r in I.walk_until(s, ["k"], "i", "v", "ok").collect()] == [11, 12, 13]
    assert {(r["start"], r["n"]) for r in I.pointer_runs(s, ["k"], "i", "ok", least=2).collect()} == {(0, 2)}


def test_implications(spark):
    rng = random.Random(5)
    holds = {"__eq__": lambda x, k: x == k, "__ne__": lambda x, k: x != k, "__lt__": lambda x, k: x < k, "__le__": lambda x, k: x <= k, "__gt__": lambda x, k: x > k, "__ge__": lambda x, k: x >= k}
    rows = [(f"v{rng.randrange(25)}", rng.choice([*holds]), rng.randrange(-4, 5)) for _ in range(110)] + [("w", "ULT", 1), ("w", "ULT", 2), ("w", None, 1), (None, "__eq__", 1), ("w", "__eq__", None)]
    got = {r["var"]: (r["n"], r["n_unique"], r["basis"]) for r in I.implication_basis(I.implication_classes(spark.createDataFrame(rows, "var string, op string, rhs_const bigint"))).collect()}
    assert got.pop("w") == (2, 2, 2)
    for var, found in got.items():
        own = {r[1:] for r in rows if r[0] == var}
        sets = {frozenset(x for x in range(-60, 61) if holds[op](x, k)) for op, k in own}
        assert found == (len(own), len(sets), sum(not any(o < s for o in sets) for s in sets))


def test_evidence(spark):
    o = spark.createDataFrame([(s, 1, "a") for s in range(4)] + [(0, 1, "b"), (0, 2, "c"), (1, 2, "c"), (2, 2, "c")], "session int, addr_key int, value string")
    assert {(r["addr_key"], r["value"]): r["stability"] for r in E.session_stability(o).collect()} == {(1, "a"): "INVARIANT", (1, "b"): "UNIQUE", (2, "c"): "COMMON"}
    f = spark.createDataFrame([("t", '{"b":1,"a":2}', "l1", 1), ("t", '{"a":2,"b":1}', "l2", 2)], "obs_type string, payload string, layer string, ts int")
    r = E.upserted(f).collect()
    assert len(r) == 1 and r[0]["n"] == 2 and r[0]["stability"] == "COMMON"
    ev = spark.createDataFrame([("H1", 1, "open"), ("H1", 2, "closed"), ("H1", 3, "open")], "item string, seq int, status string")
    assert E.investigations(ev).first()["status"] == "closed"


def test_text(spark):
    body = 'if (x == 0x10) { while (a) { DAT_1f = FUN_2; foo(3); "not implemented here"; } return 1; }'
    k = one(spark, *[c.alias(n) for n, c in X.keyword_counts(F.lit(body)).items()])
    assert (k["loops"], k["branches"], k["cyclomatic"]) == (1, 1, 2)
    assert one(spark, X.string_class(F.lit(body)), X.purity(F.lit(body)), X.string_class(F.lit(None).cast("string")))[:] == ("KNOWN_GAP", "IMPURE", None)
    texts = spark.createDataFrame([(1, "if (v == 20) x"), (2, None), (3, "")], "k int, t string")
    got = {}
    for r in X.boundary_probes(texts, "k", "t").collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert {19, 20, 21}.issubset(got[1]) and len(got[1]) <= 64 and len(got[1]) == len(set(got[1]))
    z = {r["k"]: r["n"] for r in X.constant_profile(texts, "k", "t").collect()}
    assert z == {1: 0, 2: 0, 3: 0}


def test_spectra(spark):
    cells = spark.createDataFrame([("m", r, c) for r, cs in enumerate([[0], [1], [0, 1], [2]]) for c in cs], "matrix string, row_id bigint, col_id bigint")
    assert [r["rank"] for r in spectral.gf2_staircase(cells).orderBy("pos").collect()] == [1, 2, 2, 3]
    assert spectral.gf2_rank(cells).first()["redundancy"] == 0.25
    top = spectral.singular_values(cells).orderBy("i").first()["sigma"]
    assert abs(top - math.sqrt(3)) < 1e-9
    assert abs(spectral.leverage(cells).agg(F.sum("leverage")).first()[0] - 3) < 1e-9


def test_ranks_match_a_dense_solution_both_ways(spark):
    rng = random.Random(12)
    n = 25
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(1, 1), (1, 2), (1, 2)]
    nodes, edges = spark.createDataFrame([(i,) for i in range(n + 2)], "node bigint"), spark.createDataFrame(links, "src bigint, dst bigint")
    m = np.zeros((n + 2, n + 2))
    for a, b in set(links):
        m[a, b] = 1
    # the hub vector is the dominant eigenvector of A A'
    values, vectors = np.linalg.eigh(m @ m.T)
    hub = np.abs(vectors[:, -1]) / np.abs(vectors[:, -1]).sum()
    out = m.sum(axis=1)
    step = np.where(out[:, None] > 0, m / np.maximum(out[:, None], 1), 1 / (n + 2)) * 0.85 + 0.15 / (n + 2)
    rank = np.linalg.matrix_power(step, 400)[0]
    for local in (10**6, 0):
        h = {r["node"]: r["hub"] for r in G.hits(nodes, edges, rounds=100 if local else 12, local_links=local).collect()}
        p = {r["node"]: r["rank"] for r in G.pagerank(nodes, edges, tolerance=1e-9, rounds=200 if local else 12, local_links=local).collect()}
        assert sum(abs(h[i] - hub[i]) for i in h) < (1e-3 if local else 0.2) and sum(abs(p[i] - rank[i]) for i in p) < (1e-6 if local else 0.1)
    assert G.hits(nodes, edges.limit(0)).agg({"hub": "sum"}).first()[0] == 0 and G.pagerank(nodes.limit(0), edges).count() == 0
    few = {r["node"]: (round(r["hub"], 12), round(r["authority"], 12)) for r in G.hits(nodes, edges, rounds=4, local_links=0).collect()}
    assert few == {r["node"]: (round(r["hub"], 12), round(r["authority"], 12)) for r in G.hits(nodes, edges, rounds=4).collect()}


def test_density_finds_blobs():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(5, 0.1, (60, 2)), rng.uniform(-20, 20, (6, 2))])
    got = labels_of(x, 20, 5)
    assert len(set(got[:60])) == 1 and len(set(got[60:120])) == 1 and got[0] != got[60] and got[0] >= 0


def test_grammar(spark):
    corpus = spark.createDataFrame([(1, ["a", "b", "a", "b", "c"]), (2, ["a", "b", "c"]), (3, [])], "fn_id bigint, tokens array<string>")
    rules = [r["expansion"] for r in grammar.mine(corpus, rules=3, per_round=1).collect()]
    assert rules[0] == ["a", "b"] and ["a", "b", "c"] in rules


def test_kruskal(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    assert abs(spectral.kruskal_wallis(df, "g", "v").first()["h"] - 2.4) < 1e-9


def test_monitor_stream_equals_replay(spark, tmp_path):
    rows = [(b, s, str(s // (b + 1))) for b in range(3) for s in range(40)]
    readings = spark.createDataFrame(rows, "block bigint, seq bigint, digest string")
    want = sorted(map(tuple, monitor.replay(readings).collect()))
    readings.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(readings.schema).parquet(str(tmp_path / "in"))
    q = monitor.monitored(stream).writeStream.format("memory").queryName("monitored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("monitored").collect())) == want and want
    assert pd.Series([x[3] for x in want]).isin(["change", "summary", "promote", "demote"]).all()


def test_local_graph_equals_the_rounds(spark):
    import random

    from corvane.operators import graph_local as L
    from corvane.operators.hierarchy import strong_groups

    rng = random.Random(8)
    nodes, edges = graph(spark, 30, [(rng.randrange(26), rng.randrange(26)) for _ in range(32)] + [(3, 3)])
    nodes = nodes.withColumn("own", (F.col("node") + 1) / 40).withColumn("seed", F.col("node") % 9 == 0)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    scc = strong_groups(nodes.select("node", F.col("node").alias("ord")), edges)
    rank = G.condensation_rank(scc, edges)
    for limit in (10_000, 0):
        assert rows(L.strong_components(nodes, edges, limit).select("node", "scc")) == rows(scc)
        assert rows(L.strong_components(nodes, edges, limit).select("scc", "rank").distinct()) == rows(rank)
        assert rows(L.cores(nodes, edges, limit)) == rows(G.k_core(nodes, edges))
        assert rows(L.walks(nodes, edges, "seed", limit)) == rows(G.distances(nodes, edges, nodes.filter("seed")))
        got, want = rows(L.compound(nodes, edges, "own", local_rows=limit)), rows(G.compound_score(nodes, edges, "own", scc, rank).select("node", "score"))
        assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert rows(L.component_names(nodes, edges)) == rows(G.components(nodes, edges))


def test_brody_fits_the_whole_spectrum(spark, monkeypatch):
    import numpy as np

    from corvane.plans import kernel_queries

    rng = np.random.default_rng(4)
    m = np.kron(np.eye(2), rng.random((130, 140)) < 0.3)
    m[130:, 140:] = rng.random((130, 140)) < 0.02
    cells = spark.createDataFrame([("b", int(i), int(j)) for i, j in zip(*np.nonzero(m), strict=True)], "matrix string, row_id int, col_id int")
    monkeypatch.setattr(kernel_queries, "_cells", lambda s, d: cells)
    m = m[m.any(axis=1)][:, m.any(axis=0)]
    sigma = np.linalg.svd(m, compute_uv=False)
    sigma[sigma < 1e-6] = 0
    fit = lambda v: [round(x, 4) for x in spectral.brody(spectral.spacings(spark.createDataFrame([("b", float(x)) for x in v], "matrix string, sigma double"))).first()[1:]]
    got = kernel_queries.brody_beta(spark, "").first()
    assert [got["beta"], got["ks"]] == fit(sigma) != fit(sigma[:200])
