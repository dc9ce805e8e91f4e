"""Queries over probing, joins and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.addresses import address
from ..operators import evidence as E
from ..operators import incidence as I
from ..operators import probing as B
from ..sources.relations import call_lists, global_reads, io_map, rounded
from ..sources.tables import current_functions, latest, table
from .corpus_queries import NOW
from .graph_queries import GRAPH, HEX
from .io_queries import IO, READS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {IO}, g AS (SELECT func, count(*) AS n_in, count(DISTINCT fx) AS n_out FROM io GROUP BY func) SELECT func, round(n_out / n_in, 6) AS unique_share, CASE WHEN n_out <= 1 THEN 'constant' WHEN n_out <= 3 THEN 'few' WHEN n_out > 0.8 * n_in THEN 'mixing' ELSE 'structured' END AS verdict FROM g")
def shape_verdict(s, d):
    g = io_map(s, d).groupBy("func").agg(F.count("*").alias("n_in"), F.count_distinct("fx").alias("n_out"))
    return rounded(g.select("func", (F.col("n_out") / F.col("n_in")).alias("unique_share"), B.shape_verdict(F.col("n_in"), F.col("n_out")).alias("verdict")), "unique_share")


_CALLS = "calls AS (SELECT label || '::' || func_id AS func, args[1] AS x, retval AS fx FROM execute_result WHERE error IS NULL AND len(args) > 0 AND args[1] IS NOT NULL AND retval IS NOT NULL AND label IS NOT NULL AND func_id IS NOT NULL)"


def _calls(s, d):
    c = table(s, d, "execute_result").filter("error is null and size(args) > 0 and label is not null and func_id is not null")
    return c.select(F.concat_ws("::", "label", "func_id").alias("func"), F.get("args", F.lit(0)).alias("x"), F.col("retval").alias("fx")).dropna()


@query(f"WITH {_CALLS}, c AS (SELECT func, x, fx, count(*) AS c FROM calls GROUP BY ALL), g AS (SELECT func, x, max(c) / sum(c) AS share FROM c GROUP BY ALL) SELECT func, count(*) AS n_inputs, count(*) FILTER (share < 1) AS n_divergent, round(avg(share), 6) AS mean_mode_share FROM g GROUP BY func")
def purity_replay(s, d):
    """How often repeated calls with one input gave different results."""
    g = B.replayed(_calls(s, d))
    return rounded(g.groupBy("func").agg(F.count("*").alias("n_inputs"), F.count_if("divergent").alias("n_divergent"), F.avg("mode_share").alias("mean_mode_share")), "mean_mode_share")


@query(f"WITH {_CALLS}, g AS (SELECT func, max(CASE WHEN fx < 0 THEN -(fx + 1) ELSE fx END) AS m, avg(CAST(fx < 0 AS INT)) AS neg FROM calls GROUP BY func) SELECT func, CASE WHEN m <= 1 THEN 1 WHEN m < 256 THEN 8 WHEN m < 65536 THEN 16 WHEN m < 4294967296 THEN 32 ELSE 64 END AS bits, neg > 0.1 AS signed FROM g")
def return_width(s, d):
    return B.return_width(_calls(s, d))


@query(f"WITH {IO}, b AS (SELECT func, arg_min(fx, x) AS base FROM io WHERE x >= 0 GROUP BY func) SELECT io.func, k, bit_count(xor(fx, base)) AS flipped FROM io JOIN b USING (func), range(16) AS t(k) WHERE x = CAST(1 << k AS BIGINT)")
def bit_flip_matrix(s, d):
    """Output bits that each single-bit input changes against the least input."""
    io = io_map(s, d)
    base = io.filter("x >= 0").groupBy("func").agg(F.min_by("fx", "x").alias("base"))
    bits = s.range(16).select(F.col("id").cast("int").alias("k"), F.shiftleft(F.lit(1).cast("bigint"), 0).alias("_o")).withColumn("x", F.call_function("shiftleft", F.col("_o"), F.col("k"))).drop("_o")
    return io.join(F.broadcast(bits), "x").join(base, "func").select("func", "k", F.bit_count(F.col("fx").bitwiseXOR(F.col("base"))).alias("flipped"))


@query("WITH t AS (SELECT DISTINCT ON (timing_id) timing_id, label, eval_ms FROM constraint_timing WHERE eval_ms IS NOT NULL AND NOT isnan(eval_ms) AND eval_ms >= 0 ORDER BY timing_id, label, eval_ms), s AS (SELECT label, list(eval_ms ORDER BY eval_ms) AS v, count(*) AS n FROM t GROUP BY label) SELECT label, n, v[least(n * 50 // 100, n - 1) + 1] AS median, v[least(n * 95 // 100, n - 1) + 1] AS p95, v[n] AS greatest FROM s")
def solver_timing(s, d):
    """Median, 95th percentile by position and greatest solver time of each binary."""
    t = table(s, d, "constraint_timing").filter("eval_ms is not null and not isnan(eval_ms) and eval_ms >= 0").groupBy("timing_id").agg(F.min(F.struct("label", "eval_ms")).alias("r")).select("r.*")
    return B.slow_timings(t, "label", "eval_ms")


@query("WITH g AS (SELECT CASE WHEN error IS NOT NULL AND error <> '' THEN error END AS error, ok, steps_taken FROM exec_result) SELECT ok, count(*) AS n, count(error) AS errors, max(steps_taken) AS most_steps FROM g GROUP BY ok")
def run_status(s, d):
    return table(s, d, "exec_result").groupBy("ok").agg(F.count("*").alias("n"), F.count(F.when(F.col("error") != "", F.col("error"))).alias("errors"), F.max("steps_taken").alias("most_steps"))


@query(f"WITH {READS}, f AS (SELECT DISTINCT fn, addr FROM reads) SELECT label, count(DISTINCT addr) AS n_globals, count(DISTINCT fn) AS n_fns, round(count(DISTINCT (fn, addr)) / (count(DISTINCT addr) * count(DISTINCT fn)), 6) AS density FROM reads GROUP BY label")
def population_density(s, d):
    r = global_reads(s, d).select("label", "fn", "addr").distinct()
    g = r.groupBy("label").agg(F.count_distinct("addr").alias("n_globals"), F.count_distinct("fn").alias("n_fns"), F.count("*").alias("k"))
    return rounded(g.select("label", "n_globals", "n_fns", (F.col("k") / (F.col("n_globals") * F.col("n_fns"))).alias("density")), "density")


@query("WITH b AS (SELECT s, t FROM (VALUES ('POS'), ('NEG'), ('ZERO'), ('ANY')) AS a(s), (VALUES ('POS'), ('NEG'), ('ZERO'), ('ANY')) AS c(t)) SELECT s, t, CASE WHEN s = 'ZERO' OR t = 'ZERO' THEN 'ZERO' WHEN s = 'ANY' OR t = 'ANY' THEN 'ANY' WHEN s = t THEN 'POS' ELSE 'NEG' END AS product, CASE WHEN s = 'ZERO' THEN t WHEN t = 'ZERO' THEN s WHEN s = t AND s <> 'ANY' THEN s ELSE 'ANY' END AS total FROM b")
def sign_algebra(s, d):
    pairs = s.createDataFrame([(a, b) for a in B.SIGNS for b in B.SIGNS], "s string, t string")
    return pairs.select("s", "t", B.sign_product(F.col("s"), F.col("t")).alias("product"), B.sign_sum(F.col("s"), F.col("t")).alias("total"))


@query("SELECT CASE WHEN x < 0 THEN 2048 WHEN x <= 1 THEN 64 WHEN x = 2 THEN 256 WHEN x <= 5 THEN 512 ELSE 2048 END AS probes, x AS degree FROM range(-1, 8) AS t(x)")
def probe_budget(s, d):
    return s.range(-1, 8).select(F.col("id").alias("degree"), B.budget(F.col("id")).alias("probes"))


@query("SELECT x FROM (SELECT x FROM range(64) AS t(x) UNION SELECT unnest([0, 63, 64, 100, 255, 256, 1000, 4096, 65535, 65536]))")
def dense_sweep(s, d):
    return B.sweep(s, 64, [0, 63, 64, 100, 255, 256, 1000, 4096, 65535, 65536])


@query("WITH p AS (SELECT p_size AS x, p_retailprice AS y, p_partkey FROM part), l AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) SELECT CAST(least(floor((x - x0) / (x1 - x0) * 8), 7) AS BIGINT) AS cx, CAST(least(floor((y - y0) / (y1 - y0) * 4), 3) AS BIGINT) AS cy, count(*) AS n FROM p, l GROUP BY ALL")
def grid_2d(s, d):
    p = table(s, d, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return B.gridded(p, "x", "y", 8, 4).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT name, max(v) AS v FROM (SELECT 'avalanche' AS name, 0.5 AS v UNION ALL SELECT 'other', 9) GROUP BY name) SELECT f.name, coalesce(g.v, f.value) AS value, CASE WHEN g.v IS NULL THEN 'default' ELSE 'stored' END AS source FROM (VALUES ('avalanche', 0.45), ('entropy', 0.9)) AS f(name, value) LEFT JOIN g USING (name)")
def calibration(s, d):
    defaults = s.createDataFrame([("avalanche", 0.45), ("entropy", 0.9)], "name string, value double")
    return B.calibrated(defaults, s.createDataFrame([("avalanche", 0.5), ("other", 9.0)], "name string, value double"))


@query(f"WITH {NOW} SELECT label, count(DISTINCT c) AS n_callees, count(*) AS n_named FROM (SELECT label, unnest(named_callees) AS c FROM now) WHERE c IS NOT NULL GROUP BY label HAVING bool_or(regexp_matches(c, '^(malloc|memcpy|Send|Open)'))")
def extension_trigger(s, d):
    """Binaries any of whose callees is a trigger."""
    c = current_functions(s, d, ["label", "named_callees"]).select("label", F.explode("named_callees").alias("c")).filter("c is not null")
    hit = c.filter(F.col("c").rlike("^(malloc|memcpy|Send|Open)")).select("label").distinct()
    return c.join(hit, "label", "left_semi").groupBy("label").agg(F.count_distinct("c").alias("n_callees"), F.count("*").alias("n_named"))


@query(f"WITH {GRAPH}, b AS (SELECT fn_id, coalesce(substring(pseudocode, 1, 2000), '') AS body FROM now) SELECT de.src AS fn_id, count(*) AS n_inlined, sum(length(b.body)) AS n_chars FROM de JOIN b ON b.fn_id = de.dst GROUP BY de.src")
def callee_inlining(s, d):
    """Bodies of the direct callees, each cut at 2,000 characters as the prompt that takes them asks."""
    _, edges = call_lists(s, d)
    b = current_functions(s, d, ["pseudocode"]).select(F.col("fn_id").alias("dst"), F.coalesce(F.substring("pseudocode", 1, 2000), F.lit("")).alias("body"))
    e = edges.filter("dst is not null").distinct()
    return e.join(b, "dst").groupBy(F.col("src").alias("fn_id")).agg(F.count("*").alias("n_inlined"), F.sum(F.length("body")).alias("n_chars"))


@query(f"WITH {NOW}, n AS (SELECT fn_id, label, trim(name) AS name, {HEX.format('va')} AS addr FROM now), k AS (SELECT DISTINCT label, func_id FROM execute_result WHERE func_id IS NOT NULL) SELECT DISTINCT fn_id FROM n JOIN k ON n.label = k.label AND n.name = k.func_id UNION SELECT fn_id FROM n JOIN k ON n.label = k.label AND n.addr = {HEX.format('k.func_id')}")
def named_or_addressed(s, d):
    """Functions that were probed, named by name or by address: two equi-joins instead of one with OR."""
    n = current_functions(s, d, ["label", "name", "va"]).select("fn_id", "label", F.trim("name").alias("name"), address(F.col("va")).alias("addr"))
    k = table(s, d, "execute_result").filter("func_id is not null").select("label", F.col("func_id").alias("name")).distinct()
    by_name = n.join(k, ["label", "name"], "left_semi").select("fn_id")
    by_addr = n.join(k.select("label", address(F.col("name")).alias("addr")).dropna(), ["label", "addr"], "left_semi").select("fn_id")
    return by_name.union(by_addr).distinct()


@query(f"WITH {NOW}, a AS (SELECT DISTINCT label, {HEX.format('va')} AS addr FROM now), r AS (SELECT DISTINCT label, {HEX.format('va')} AS addr FROM exec_result) SELECT (SELECT count(*) FROM (SELECT * FROM a WHERE addr IS NOT NULL UNION SELECT * FROM r WHERE addr IS NOT NULL)) AS n_union, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM r WHERE addr IS NOT NULL)) AS n_both, (SELECT count(*) FROM (SELECT * FROM r WHERE addr IS NOT NULL EXCEPT SELECT * FROM a)) AS n_runs_only")
def set_operations(s, d):
    """Functions known from dumps and from runs: union, intersection, difference."""
    a = current_functions(s, d, ["label", "va"]).select("label", address(F.col("va")).alias("addr")).dropna().distinct()
    r = table(s, d, "exec_result").select("label", address(F.col("va")).alias("addr")).dropna().distinct()
    both = a.withColumn("in_a", F.lit(1)).join(r.withColumn("in_r", F.lit(1)), ["label", "addr"], "full")
    return both.agg(F.count("*").alias("n_union"), F.count_if(F.col("in_a").isNotNull() & F.col("in_r").isNotNull()).alias("n_both"), F.count_if(F.col("in_a").isNull()).alias("n_runs_only"))


@query(f"WITH {NOW}, e AS (SELECT label, fn_id FROM now WHERE NOT starts_with(trim(name), 'FUN_') AND name IS NOT NULL AND caller_count = 0), z AS (SELECT label, fn_id FROM now WHERE depth = 0), o AS (SELECT label, fn_id FROM now WHERE caller_count = 0 AND callee_count > 0) SELECT label, fn_id FROM e UNION ALL SELECT label, fn_id FROM z WHERE label NOT IN (SELECT label FROM e) UNION ALL SELECT label, fn_id FROM o WHERE label NOT IN (SELECT label FROM e) AND label NOT IN (SELECT label FROM z)")
def seed_cascade(s, d):
    """Seeds of each binary: named functions nobody calls, else those at depth 0, else any that only call."""
    n = current_functions(s, d, ["label", "name", "caller_count", "callee_count", "depth"])
    rank = F.when(F.col("name").isNotNull() & ~F.trim("name").startswith("FUN_") & (F.col("caller_count") == 0), 1).when(F.col("depth") == 0, 2).when((F.col("caller_count") == 0) & (F.col("callee_count") > 0), 3)
    r = n.withColumn("k", rank).filter("k is not null")
    best = r.groupBy("label").agg(F.min("k").alias("b"))
    # a function of rank 1 may be at depth 0 too, but then its binary takes rank 1
    return r.join(best, "label").filter("k = b").select("label", "fn_id")


@query("WITH o AS (SELECT user_id AS k, event_id AS i, CAST(value * 100 AS BIGINT) AS v FROM events), g AS (SELECT k, i, i - row_number() OVER (PARTITION BY k ORDER BY i) AS run FROM o WHERE v >= 2000) SELECT k, min(i) AS start, count(*) AS n FROM g GROUP BY k, run HAVING count(*) >= 2")
def pointer_runs(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("i"), (F.col("value") * 100).cast("bigint").alias("v")).withColumn("ok", F.col("v") >= 2000)
    return I.pointer_runs(e, ["k"], "i", "ok", least=2)


@query("WITH o AS (SELECT DISTINCT event_type, event_id // 4 AS pos FROM events WHERE value > 50), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY event_type ORDER BY pos) <= 8 THEN 0 ELSE 1 END AS b FROM o), r AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY pos) AS run FROM g) SELECT event_type, min(pos) AS \"start\", max(pos) AS \"end\", count(*) AS n FROM r GROUP BY event_type, run")
def change_runs(s, d):
    e = table(s, d, "events").filter("value > 50").select("event_type", F.expr("event_id div 4").alias("at"))
    return I.change_runs(e, ["event_type"], "at")


@query("WITH v AS (SELECT json_extract_string(props, '$.k') AS k, CAST(value AS BIGINT) AS v FROM events), g AS (SELECT k, count(DISTINCT v) AS n, max(v) AS hi, bool_and(v IN (0, 1)) AS bit FROM v GROUP BY k) SELECT CAST(k AS BIGINT) AS \"offset\", CASE WHEN bit AND n > 1 THEN 'BOOL' WHEN n = 1 THEN 'CONSTANT' WHEN hi < 65536 THEN 'SMALL_INT' ELSE 'UINT32' END AS kind, n > 1 AS mutated FROM g")
def field_types(s, d):
    e = table(s, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("offset"), F.round("value", 0).cast("bigint").alias("value"))
    return E.field_types(e)


@query("WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls_id ORDER BY classified_ts DESC) AS rn FROM classify_result) WHERE rn = 1), x AS (SELECT lower(trim(func_class)) AS got, CASE WHEN avalanche_mean > 0.35 THEN 'hash' ELSE 'guard' END AS expected FROM r) SELECT count(*) AS total, count(*) FILTER (got = expected) AS correct, count(*) FILTER (NOT coalesce(got = expected, false)) AS wrong, 0 AS crashed, round(avg(CAST(coalesce(got = expected, false) AS INT)), 6) AS accuracy FROM x")
def sweep_accuracy(s, d):
    r = latest(table(s, d, "classify_result"), ["cls_id"], "classified_ts", ["func_class", "avalanche_mean"])
    x = r.select(F.lower(F.trim("func_class")).alias("got"), F.when(F.col("avalanche_mean") > 0.35, "hash").otherwise("guard").alias("expected"), F.lit(None).cast("string").alias("error"))
    return rounded(E.accuracy(x), "accuracy")


@query(f"WITH {NOW}, f AS (SELECT fn_id, unnest(floors) AS tag FROM now) SELECT tag, count(*) AS n FROM f WHERE tag IS NOT NULL GROUP BY tag")
def floor_tags(s, d):
    return current_functions(s, d, ["floors"]).select(F.explode("floors").alias("tag")).filter("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


@query("WITH j AS (SELECT report_id, CAST(json_extract_string(payload, '$.n_globals') AS BIGINT) AS g, CAST(json_extract_string(payload, '$.n_fns') AS BIGINT) AS f FROM geometry_report WHERE payload IS NOT NULL AND json_valid(payload)) SELECT report_id, max(g) AS n_globals, max(f) AS n_fns FROM j WHERE g IS NOT NULL AND f IS NOT NULL GROUP BY report_id")
def report_sizes(s, d):
    """Sizes that readable reports state at their top level."""
    r = table(s, d, "geometry_report").filter("payload is not null").select("report_id", F.try_parse_json("payload").alias("v"))
    g = r.select("report_id", F.try_variant_get("v", "$.n_globals", "bigint").alias("g"), F.try_variant_get("v", "$.n_fns", "bigint").alias("f")).dropna()
    return g.groupBy("report_id").agg(F.max("g").alias("n_globals"), F.max("f").alias("n_fns"))


@query("WITH c AS (SELECT label, count(*) AS n FROM documents GROUP BY label), k AS (SELECT n, row_number() OVER (ORDER BY n DESC, label) AS r FROM c) SELECT round(regr_slope(ln(n), ln(r)), 5) AS slope, round(regr_r2(ln(n), ln(r)), 5) AS r2 FROM k")
def loglog_regression(s, d):
    """Slope of log count over log rank of the documents' binaries; ranks of binaries, not of documents."""
    c = table(s, d, "documents").groupBy("label").agg(F.count("*").alias("n"))
    k = c.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last("label"))))
    y, x = F.log(F.col("n").cast("double")), F.log(F.col("r").cast("double"))
    return rounded(k.agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2")), "slope", "r2", digits=5)
