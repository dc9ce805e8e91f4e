"""Queries over inputs and outputs, incidence tables and evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import incidence as I
from ..operators import iomap as M
from ..sources.relations import constraint_rows, first_steps, global_reads, io_map, observations, rounded
from ..sources.tables import latest, table
from .lineage import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}

IO = "io AS (SELECT func, x, fx FROM (SELECT label || '::' || func_id AS func, args[1] AS x, retval AS fx, row_number() OVER (PARTITION BY label || '::' || func_id, args[1] ORDER BY run_ts, probe_id, retval) AS rn FROM execute_result WHERE error IS NULL AND len(args) > 0 AND args[1] IS NOT NULL AND retval IS NOT NULL AND label IS NOT NULL AND func_id IS NOT NULL) WHERE rn = 1)"
READS = "runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY run_ts DESC, va DESC) AS rn FROM exec_result WHERE global_reads IS NOT NULL) WHERE rn = 1), reads AS (SELECT label, exec_id AS fn, e.key AS addr, e.value AS size FROM (SELECT label, exec_id, unnest(map_entries(global_reads)) AS e FROM runs)), r AS (SELECT DISTINCT label, fn, addr FROM reads)"
CLUSTERS = READS + ", gap AS (SELECT label, addr, CASE WHEN addr - lag(addr) OVER (PARTITION BY label ORDER BY addr) <= 4096 THEN 0 ELSE 1 END AS b FROM (SELECT DISTINCT label, addr FROM reads)), c0 AS (SELECT label, addr, sum(b) OVER (PARTITION BY label ORDER BY addr) - 1 AS cluster FROM gap), cl AS (SELECT label, addr, cluster, min(addr) OVER (PARTITION BY label, cluster) AS base, addr - min(addr) OVER (PARTITION BY label, cluster) AS \"offset\" FROM c0)"
PAIRS = "pairs AS (SELECT p.label, p.addr AS a, q.addr AS b, count(DISTINCT p.fn) AS weight FROM r p JOIN r q ON p.label = q.label AND p.fn = q.fn AND p.addr < q.addr GROUP BY ALL)"
CONS = "cons AS (SELECT exec_id, pos, any_value(label) AS label, any_value(c) AS c FROM (SELECT exec_id, label, unnest(constraints) AS c, generate_subscripts(constraints, 1) AS pos FROM exec_result) WHERE c IS NOT NULL AND c.formula IS NOT NULL GROUP BY exec_id, pos)"
OBS = "obs AS (SELECT user_id % 10 AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS addr_key, event_type AS value, ts, event_id AS seq FROM events), adr AS (SELECT addr_key, addr_key * 1000003 + seq % 7 * 65536 AS addr FROM obs)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {IO} SELECT func, x, fx FROM io")
def io_first_writes(s, d):
    return io_map(s, d)


@query(f"""WITH {IO}, p AS (SELECT a.func, k, xor(a.fx, b.fx) AS dd FROM io a, range(8) AS t(k), io b WHERE a.func = b.func AND b.x = xor(a.x, CAST(1 << k AS BIGINT))), bk AS (SELECT func, k, avg(bit_count(dd) / 64) AS m, count(DISTINCT dd) AS n FROM p GROUP BY ALL)
SELECT func, round(avg(m), 6) AS avalanche, round(avg(CAST(n = 1 AS INT)), 6) AS deriv_const_frac FROM bk GROUP BY func""")
def avalanche(s, d):
    return rounded(M.avalanche(io_map(s, d)), "avalanche", "deriv_const_frac")


@query(f"""WITH {IO}, c AS (SELECT func, fx, count(*) AS c FROM io GROUP BY ALL), n AS (SELECT func, sum(c) AS n FROM c GROUP BY func) SELECT func, max(n) AS n_in, count(*) AS n_out, round(CASE WHEN max(n) > 1 THEN least(1, sum(-c / n * log2(c / n)) / log2(max(n))) ELSE 0 END, 6) AS entropy, round(count(*) / max(n), 6) AS bijectivity, min(fx) AS out_min, max(fx) AS out_max, arg_max(fx, struct_pack(c := c, f := -CAST(fx AS HUGEINT))) AS sentinel, round(max(c) / max(n), 6) AS sentinel_frac FROM c JOIN n USING (func) GROUP BY func""")
def output_shape(s, d):
    return rounded(M.output_shape(io_map(s, d)), "entropy", "bijectivity", "sentinel_frac")


@query(f"WITH {IO}, l AS (SELECT func, fx, lead(fx) OVER (PARTITION BY func ORDER BY x) AS n FROM io) SELECT func, round(avg(CAST(n >= fx AS INT)), 6) AS inc, round(avg(CAST(n <= fx AS INT)), 6) AS dec FROM l WHERE n IS NOT NULL GROUP BY func")
def monotonicity(s, d):
    return rounded(M.monotonicity(io_map(s, d)), "inc", "dec")


@query(f"WITH {IO}, p AS (SELECT a.func, CAST(b.fx AS DOUBLE) - CAST(a.fx AS DOUBLE) AS dd FROM io a JOIN io b ON a.func = b.func AND CAST(b.x AS HUGEINT) = CAST(a.x AS HUGEINT) + 1) SELECT func, round(avg(dd), 3) AS delta_mean, round(CASE WHEN avg(dd) <> 0 THEN stddev_pop(dd) / abs(avg(dd)) ELSE 0 END, 4) AS delta_cv FROM p GROUP BY func")
def first_difference(s, d):
    return rounded(rounded(M.first_difference(io_map(s, d)), "delta_mean", digits=3), "delta_cv", digits=4)


@query(f"WITH {IO}, p AS (SELECT a.func, CAST(b.x AS HUGEINT) - a.x AS k, CAST(a.fx = b.fx AS INT) AS e FROM io a JOIN io b ON a.func = b.func AND CAST(b.x AS HUGEINT) - a.x IN (2, 3)) SELECT func, round(coalesce(avg(e) FILTER (k = 2), 0), 6) AS period2, round(coalesce(avg(e) FILTER (k = 3), 0), 6) AS period3 FROM p GROUP BY func")
def periodicity(s, d):
    return rounded(M.periodicity(io_map(s, d)), "period2", "period3")


_WRAP = "CAST(CASE WHEN {0} > 9223372036854775807 THEN {0} - 18446744073709551616 WHEN {0} < -9223372036854775808 THEN {0} + 18446744073709551616 ELSE {0} END AS BIGINT)"


@query(f"WITH {IO}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY func ORDER BY x) AS i FROM io) WHERE i <= 20), p AS (SELECT a.func, {_WRAP.format('(CAST(a.x AS HUGEINT) + b.x)')} AS x, {_WRAP.format('(CAST(a.fx AS HUGEINT) + b.fx)')} AS s FROM h a JOIN h b ON a.func = b.func AND a.i < b.i) SELECT p.func, count(*) AS n_pairs, round(avg(CAST(io.fx = p.s AS INT)), 6) AS add_linear FROM p JOIN io ON io.func = p.func AND io.x = p.x GROUP BY p.func")
def add_linear(s, d):
    return rounded(M.additivity(io_map(s, d)), "add_linear")


@query(f"WITH {IO}, l AS (SELECT * FROM io WHERE x BETWEEN 0 AND 31), n AS (SELECT func, count(*) AS n FROM l GROUP BY func), c AS (SELECT func, s, bit_xor(fx) AS c FROM l, range(32) AS t(s) WHERE (x & s) = x GROUP BY ALL), g AS (SELECT func, max(bit_count(CAST(s AS BIGINT))) AS g FROM c WHERE (c & 31) <> 0 GROUP BY func) SELECT func, CASE WHEN n < 16 THEN -1 ELSE coalesce(g, 0) END AS anf_degree FROM n LEFT JOIN g USING (func)")
def anf_degree(s, d):
    return M.anf_degree(io_map(s, d))


@query(f"WITH {IO} SELECT func, bool_and(fx IN (0, 1)) AS is_boolean, count(DISTINCT fx) = 1 AS is_constant, coalesce(avg(abs(CAST(fx AS DOUBLE) - CAST(x AS DOUBLE)) / abs(CAST(x AS DOUBLE))) FILTER (x <> 0) < 0.01, false) AS is_near_identity FROM io GROUP BY func")
def identity_flags(s, d):
    return M.identity_flags(io_map(s, d))


@query("SELECT label || '::' || func_id AS func, round(stddev_pop(elapsed_us) / abs(avg(elapsed_us)), 4) AS timing_cv FROM execute_result WHERE error IS NULL AND elapsed_us > 0 AND NOT isnan(elapsed_us) AND NOT isinf(elapsed_us) AND label IS NOT NULL AND func_id IS NOT NULL GROUP BY ALL")
def timing_cv(s, d):
    return rounded(_times(s, d), "timing_cv", digits=4)


def _times(s, d):
    calls = table(s, d, "execute_result").filter("label is not null and func_id is not null").withColumn("func", F.concat_ws("::", "label", "func_id"))
    return M.timing(calls, "elapsed_us", "error")


@query()
def behaviour_class(s, d):
    """Class, confidence and signs of every probed function."""
    m = M.metrics(cut(io_map(s, d)), _times(s, d))
    return m.select("func", M.function_class().alias("c"), M.synopsis().alias("synopsis")).select("func", "c.func_class", "c.confidence", "synopsis")


@query()
def vector_match(s, d):
    """The reference function that each probed function's inputs and outputs fit best, and whether that is a match."""
    best = M.best_match(M.reference_matches(io_map(s, d)), list(M.REFERENCE_FUNCTIONS), least=0.0)
    return rounded(best, "score").withColumn("matched", F.col("score") >= 0.70)


@query(f"WITH {IO} SELECT a.func, a.x, a.fx FROM (SELECT *, lag(fx) OVER w AS p, lead(fx) OVER w AS n FROM io WINDOW w AS (PARTITION BY func ORDER BY x)) a WHERE p <> fx OR n <> fx")
def transitions(s, d):
    return M.transitions(io_map(s, d))


@query(f"""WITH {IO}, a AS (SELECT func, x, fx, row_number() OVER (PARTITION BY func, fx ORDER BY abs(CAST(x AS HUGEINT)), x) = 1 AS f, coalesce(lag(fx) OVER w <> fx, false) OR coalesce(lead(fx) OVER w <> fx, false) AS e, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY func) AS n FROM io WINDOW w AS (PARTITION BY func ORDER BY x)),
p AS (SELECT *, CASE WHEN f THEN 0 WHEN e THEN 1 WHEN i % greatest(n // 16, 1) = 0 THEN 2 ELSE 3 END AS p FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY func ORDER BY p, abs(CAST(x AS HUGEINT)), x) AS k FROM p WHERE p < 3) SELECT func, x, fx FROM k WHERE k <= 16""")
def discriminating_inputs(s, d):
    """At most sixteen inputs of each function that tell its outputs apart."""
    return M.discriminating(io_map(s, d))


# ---- incidence


@query(f"WITH {CLUSTERS} SELECT label, addr, cluster, base, \"offset\" FROM cl")
def gap_clusters(s, d):
    return I.gap_clusters(global_reads(s, d))


def _clustered(s, d):
    reads = cut(global_reads(s, d))
    return reads, cut(I.gap_clusters(reads))


@query(f"WITH {READS}, {PAIRS} SELECT label, a, b, weight FROM pairs")
def coaccess(s, d):
    return I.co_access(global_reads(s, d))


@query(f"WITH {CLUSTERS}, {PAIRS}, n AS (SELECT label, cluster, count(*) AS n FROM cl GROUP BY ALL), k AS (SELECT x.label, x.cluster, count(*) AS k FROM pairs JOIN cl x ON x.addr = a AND x.label = pairs.label JOIN cl y ON y.addr = b AND y.label = pairs.label WHERE x.cluster = y.cluster GROUP BY ALL), o AS (SELECT label, cluster, n, CASE WHEN n > 1 THEN coalesce(k, 0) / (n * (n - 1) / 2) ELSE 0 END AS density FROM n LEFT JOIN k USING (label, cluster)) SELECT label, cluster, n, round(density, 6) AS density, CASE WHEN density < 0.2 THEN 'ARRAY' WHEN density > 0.5 THEN 'MONOLITHIC' ELSE 'MIXED' END AS pattern FROM o")
def coaccess_density(s, d):
    reads, clusters = _clustered(s, d)
    return rounded(I.co_access_density(clusters, I.co_access(reads, clusters)), "density")


@query(f"WITH {CLUSTERS}, {PAIRS}, g AS (SELECT label, addr, sum(weight) AS degree FROM (SELECT label, a AS addr, weight FROM pairs UNION ALL SELECT label, b, weight FROM pairs) GROUP BY ALL), k AS (SELECT label, cluster, addr, degree, row_number() OVER (PARTITION BY label, cluster ORDER BY degree DESC, addr) AS rank FROM g JOIN cl USING (label, addr)) SELECT * FROM k WHERE rank <= 3")
def hub_globals(s, d):
    """The three addresses of each cluster that are read together with others most."""
    reads, clusters = _clustered(s, d)
    return I.hubs(I.co_access(reads), clusters)


@query(f"WITH {CLUSTERS}, a AS (SELECT label, cluster, count(*) AS n, avg(CAST(\"offset\" % 4 = 0 AS INT)) AS t3 FROM cl GROUP BY ALL) SELECT label, cluster, n, round(t3, 6) AS t3, round((t3 * n - 0.25 * n) / sqrt(n * 0.1875), 6) AS z, CASE WHEN t3 >= 0.8 THEN 'STRUCT' WHEN t3 >= 0.4 THEN 'ENUM' ELSE 'LOOKUP' END AS kind FROM a")
def alignment_z(s, d):
    return rounded(I.alignment(_clustered(s, d)[1], ["label", "cluster"]), "t3", "z")


_GAPS = "gaps AS (SELECT label, cluster, gap FROM (SELECT label, cluster, \"offset\" - lag(\"offset\") OVER (PARTITION BY label, cluster ORDER BY \"offset\") AS gap FROM cl) WHERE gap IS NOT NULL)"


@query(f"WITH {CLUSTERS}, {_GAPS}, c AS (SELECT label, cluster, gap, count(*) AS c FROM gaps GROUP BY ALL), p AS (SELECT label, cluster, c / sum(c) OVER (PARTITION BY label, cluster) AS p FROM c) SELECT label, cluster, round(sum(-p * log2(p)), 6) AS gap_entropy FROM p GROUP BY ALL")
def gap_entropy(s, d):
    return rounded(I.gap_entropy(_clustered(s, d)[1]), "gap_entropy")


@query(f"""WITH {CLUSTERS}, {_GAPS}, c AS (SELECT label, cluster, gap, count(*) AS c FROM gaps WHERE gap > 0 GROUP BY ALL), n AS (SELECT label, cluster, sum(c) AS n FROM c GROUP BY ALL), t AS (SELECT x.label, x.cluster, x.gap AS stride, sum(CASE WHEN y.gap % x.gap = 0 THEN y.c ELSE 0 END) / any_value(n) AS share FROM c x JOIN c y USING (label, cluster) JOIN n USING (label, cluster) GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, cluster ORDER BY share DESC, stride) AS rn FROM t) WHERE rn = 1), sp AS (SELECT label, cluster, max("offset") AS span, count(DISTINCT "offset") FILTER ("offset" > 0) AS nz FROM cl GROUP BY ALL)
SELECT label, cluster, CASE WHEN share >= 0.75 AND nz >= 3 THEN stride ELSE 0 END AS stride, round(coalesce(share, 0), 6) AS share, CASE WHEN share >= 0.75 AND nz >= 3 THEN span // stride + 1 ELSE 0 END AS elements FROM sp LEFT JOIN b USING (label, cluster)""")
def modal_stride(s, d):
    return rounded(I.modal_stride(_clustered(s, d)[1]), "share")


@query(f"WITH {CLUSTERS}, {_GAPS}, g AS (SELECT label, cluster, list_reduce(list_prepend(CAST(0 AS BIGINT), list(gap ORDER BY gap)), lambda x, y: gcd(x, y)) AS g FROM gaps GROUP BY ALL), n AS (SELECT label, cluster, count(*) AS n FROM cl GROUP BY ALL) SELECT label, cluster, CASE WHEN n >= 4 THEN coalesce(g, 0) ELSE 0 END AS gcd FROM n LEFT JOIN g USING (label, cluster)")
def gcd_stride(s, d):
    return I.gcd_stride(_clustered(s, d)[1])


_STEPS = "steps AS (SELECT label, exec_id, var, min(pos - 1) AS first_step FROM (SELECT label, exec_id, pos, unnest(c.vars) AS var FROM cons) WHERE var IS NOT NULL GROUP BY ALL)"


@query(f"WITH {CONS}, {_STEPS}, m AS (SELECT label, var, list(first_step ORDER BY first_step) AS v FROM steps GROUP BY ALL), k AS (SELECT label, var, v[len(v) // 2 + 1] AS median_step FROM m) SELECT label, var, median_step, CASE WHEN median_step <= 3 THEN 'guard' WHEN median_step >= 10 THEN 'compute' ELSE 'neutral' END AS kind FROM k")
def guard_compute(s, d):
    """Whether variables are met at the start of a run or later on, by the place of their first constraint."""
    return I.guard_or_compute(first_steps(s, d), "var")


@query(f"WITH {READS} SELECT label, addr, count(DISTINCT fn) AS n_fns, max(size) AS size FROM reads GROUP BY ALL")
def populations(s, d):
    return I.populations(global_reads(s, d))


@query(f"WITH {READS}, c AS (SELECT label, addr, count(DISTINCT fn) AS c FROM reads GROUP BY ALL), k AS (SELECT label, c, row_number() OVER (PARTITION BY label ORDER BY c DESC, addr) AS i FROM c) SELECT label, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN CASE WHEN isnan(corr(ln(i + 1), ln(greatest(c, 1)))) THEN NULL ELSE corr(ln(i + 1), ln(greatest(c, 1))) END ELSE 0 END, 5) AS r FROM k GROUP BY label HAVING max(c) > min(c)")
def powerlaw_r(s, d):
    """Correlation of log rank and log count of each binary's globals; binaries of even counts have none and are left out."""
    c = global_reads(s, d).groupBy("label", F.col("addr").alias("item")).agg(F.count_distinct("fn").alias("c"))
    uneven = c.groupBy("label").agg((F.max("c") > F.min("c")).alias("u")).filter("u").select("label")
    return rounded(I.power_law_r(c.join(uneven, "label", "left_semi"), "label"), "r", digits=5)


_TYPE = "CASE WHEN c.formula.op = '__eq__' AND c.formula.rhs_var IS NOT NULL THEN 'RING_BUFFER' WHEN c.formula.op = '__eq__' AND c.formula.rhs_const = 0 THEN 'POINTER' WHEN c.formula.op = '__eq__' THEN 'ENUM' WHEN c.formula.op = '__ne__' AND c.formula.rhs_var IS NOT NULL THEN 'RING_BUFFER' WHEN c.formula.op = '__ne__' THEN 'EXCLUSION' WHEN c.formula.op IN ('__lt__','__le__','ULT','ULE') AND c.formula.rhs_var IS NOT NULL THEN 'RING_BUFFER' WHEN c.formula.op IN ('__lt__','__le__','ULT','ULE') AND c.formula.rhs_const <> 0 THEN 'RANGE' WHEN c.formula.op IN ('__gt__','__ge__','UGT','UGE') AND c.formula.rhs_var IS NOT NULL THEN 'RING_BUFFER' WHEN c.formula.op IN ('__gt__','__ge__','UGT','UGE') AND c.formula.rhs_const = 0 THEN 'SIZE' WHEN c.formula.op IN ('__gt__','__ge__','UGT','UGE') THEN 'RANGE' WHEN c.formula.op IN ('SLT','SLE','SGT','SGE','__slt__','__sle__','__sgt__','__sge__') THEN 'SIGNED' WHEN c.formula.op IN ('__and__','And') THEN 'FLAGS' WHEN c.formula.op IN ('__or__','Or') THEN 'COMPOSITE' ELSE 'UNKNOWN' END"


def _typed(s, d):
    c = constraint_rows(s, d)
    return c.withColumn("type", I.constraint_type(F.col("op"), F.col("rhs_var"), F.col("rhs_const")))


@query(f"WITH {CONS} SELECT {_TYPE} AS type, count(*) AS n FROM cons GROUP BY ALL")
def constraint_types(s, d):
    return _typed(s, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {CONS}, t AS (SELECT label || '::' || regexp_replace(regexp_replace(regexp_replace(v, '_\\d+_\\d+$', ''), '^global_', 'g_'), '^field_', 'f_') AS var, type FROM (SELECT label, unnest(c.vars) AS v, {_TYPE} AS type FROM cons) WHERE v IS NOT NULL), k AS (SELECT var, type, count(*) AS c FROM t GROUP BY ALL), b AS (SELECT var, type, row_number() OVER (PARTITION BY var ORDER BY c DESC, type DESC) AS rn FROM k WHERE type <> 'UNKNOWN') SELECT k.var, sum(c) AS n, coalesce(any_value(b.type), 'UNKNOWN') AS dominant FROM k LEFT JOIN b ON b.var = k.var AND rn = 1 GROUP BY k.var")
def dominant_field_types(s, d):
    from ..operators.textfeat import canonical_name

    v = _typed(s, d).select("label", F.explode("vars").alias("v"), "type").filter("v is not null")
    return I.dominant_types(v.select(F.concat_ws("::", "label", canonical_name(F.col("v"))).alias("var"), "type"))


@query(f"WITH {CONS} SELECT label || '::' || c.formula.lhs AS var, count(DISTINCT c.formula.rhs_const) AS cardinality FROM cons WHERE c.formula.rhs_const > 0 AND c.formula.rhs_const < 16777216 AND c.formula.lhs IS NOT NULL AND label IS NOT NULL GROUP BY ALL")
def semantic_cardinality(s, d):
    """Distinct constants of meaning that each variable is compared with."""
    c = constraint_rows(s, d).filter("lhs is not null and label is not null and rhs_const is not null")
    cls = I.constant_class(F.col("rhs_const"), F.lit(0x140000000), F.lit(0x150000000))
    kept = c.withColumn("cls", cls).filter(F.col("cls").isin("SMALL_INT_SEMANTIC", "MEDIUM_INT_SEMANTIC"))
    return kept.groupBy(F.concat_ws("::", "label", "lhs").alias("var")).agg(F.count_distinct("rhs_const").alias("cardinality"))


_IMPL = CONS + """, f AS (SELECT DISTINCT label || '::' || c.formula.lhs AS var, c.formula.op AS op, CAST(c.formula.rhs_const AS HUGEINT) AS k FROM cons WHERE c.formula.rhs_const IS NOT NULL AND c.formula.lhs IS NOT NULL AND c.formula.op IS NOT NULL AND label IS NOT NULL),
cls AS (SELECT var, CASE WHEN op IN ('__lt__', '__le__') THEN 'U' WHEN op IN ('__gt__', '__ge__') THEN 'L' WHEN op = '__eq__' THEN 'E' WHEN op = '__ne__' THEN 'N' ELSE op END AS kind, CASE op WHEN '__lt__' THEN k - 1 WHEN '__gt__' THEN k + 1 ELSE k END AS bound, count(*) AS n FROM f GROUP BY ALL),
imp AS (SELECT b.var, b.kind, b.bound, any_value(b.n) AS n, bool_or(coalesce(CASE b.kind WHEN 'U' THEN (a.kind = 'U' AND a.bound < b.bound) OR (a.kind = 'E' AND a.bound <= b.bound) WHEN 'L' THEN (a.kind = 'L' AND a.bound > b.bound) OR (a.kind = 'E' AND a.bound >= b.bound) WHEN 'N' THEN (a.kind = 'U' AND a.bound < b.bound) OR (a.kind = 'L' AND a.bound > b.bound) OR (a.kind = 'E' AND a.bound <> b.bound) END, false)) AS implied FROM cls b JOIN cls a ON a.var = b.var GROUP BY b.var, b.kind, b.bound)"""


def _formulas(s, d):
    c = constraint_rows(s, d).filter("rhs_const is not null and lhs is not null and label is not null")
    return c.select(F.concat_ws("::", "label", "lhs").alias("var"), "op", "rhs_const")


@query(f"WITH {_IMPL} SELECT var, sum(n) AS n, count(*) AS n_unique, count(*) FILTER (NOT implied) AS basis, round(1 - count(*) FILTER (NOT implied) / count(*), 6) AS redundancy FROM imp GROUP BY var")
def implication_basis(s, d):
    """Distinct formulas of each variable: classes of equivalent ones, and the least set that implies all."""
    return rounded(I.implication_basis(I.implication_classes(_formulas(s, d))), "redundancy")


@query(f"WITH {_IMPL} SELECT var, kind, CAST(bound AS DOUBLE) AS bound FROM imp WHERE implied")
def implied_constraints(s, d):
    """The classes that are not in the basis: what its members already say."""
    return I.implication_classes(_formulas(s, d)).filter("implied").select("var", "kind", F.col("bound").cast("double").alias("bound"))


@query("WITH o AS (SELECT exec_id, pos, any_value(c.vars) AS vars, any_value(c.is_ambiguous) AS amb FROM (SELECT exec_id, unnest(constraints) AS c, generate_subscripts(constraints, 1) AS pos FROM exec_result) WHERE c IS NOT NULL AND c.formula IS NOT NULL GROUP BY exec_id, pos), a AS (SELECT exec_id, coalesce(bool_or(amb), false) AS ambiguous FROM o GROUP BY exec_id) SELECT o.exec_id, pos - 1 AS pos, ambiguous FROM o JOIN a USING (exec_id) WHERE len(vars) > 0")
def constraint_notes(s, d):
    """Constraints with variables; an ambiguous one makes all of its run so."""
    c = cut(constraint_rows(s, d))
    a = c.groupBy("exec_id").agg(F.coalesce(F.bool_or("is_ambiguous"), F.lit(False)).alias("ambiguous"))
    return c.filter(F.size("vars") > 0).select("exec_id", "pos").join(a, "exec_id")


# ---- evidence


@query(f"WITH {OBS}, n AS (SELECT count(DISTINCT session) AS n FROM obs), g AS (SELECT addr_key, value, count(DISTINCT session) AS n_sessions, count(*) AS n_seen FROM obs GROUP BY ALL) SELECT addr_key, value, n_sessions, n_seen, round(n_sessions / n, 6) AS freq, CASE WHEN n_sessions / n >= 1 THEN 'INVARIANT' WHEN n_sessions / n >= 0.75 THEN 'COMMON' WHEN n_sessions = 1 THEN 'UNIQUE' ELSE 'EPHEMERAL' END AS stability FROM g, n")
def session_stability(s, d):
    return rounded(E.session_stability(observations(s, d)), "freq")


@query(f"WITH {OBS}, g AS (SELECT addr_key, list(addr ORDER BY addr) AS v, min(addr) AS lo, max(addr) AS hi, stddev_pop(addr) AS sd FROM adr GROUP BY addr_key) SELECT addr_key, v[len(v) // 2 + 1] AS representative, round(sd, 3) AS spread, CASE WHEN lo = hi THEN 'ADDRESS_STATIC' WHEN sd < 1048576 THEN 'HEAP_STABLE' WHEN sd < 67108864 THEN 'HEAP_MODERATE' ELSE 'VOLATILE' END AS kind FROM g")
def address_stability(s, d):
    return rounded(E.address_stability(observations(s, d)), "spread", digits=3)


@query(f"WITH {OBS}, n AS (SELECT count(DISTINCT session) AS n FROM obs), g AS (SELECT addr_key, value, count(DISTINCT session) AS n_sessions FROM obs GROUP BY ALL) SELECT addr_key, value, CASE WHEN value = 'view' THEN 'KNOWN_KEY' ELSE 'UNKNOWN_INVARIANT' END AS verdict FROM g, n WHERE n_sessions / n >= 0.75")
def oracle_verdict(s, d):
    """Stable values against a list of verified ones."""
    verified = s.createDataFrame([("view",)], "value string")
    return E.against_verified(E.session_stability(observations(s, d)), verified).select("addr_key", "value", "verdict")


@query("WITH k AS (SELECT 'props' AS obs_type, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS payload, event_type AS layer, ts FROM events) SELECT substring(sha1(obs_type || ':' || payload), 1, 12) AS id, count(*) AS n, count(DISTINCT layer) AS n_layers, CASE WHEN count(DISTINCT layer) >= 3 OR count(*) >= 5 THEN 'INVARIANT' WHEN count(DISTINCT layer) >= 2 OR count(*) >= 3 THEN 'COMMON' ELSE 'EPHEMERAL' END AS stability FROM k GROUP BY obs_type, payload")
def kb_stability(s, d):
    """Facts by canonical payload, with their tiers."""
    return _facts(s, d).select("id", "n", F.size("layers").alias("n_layers"), "stability")


def _facts(s, d):
    e = table(s, d, "events").select(F.lit("props").alias("obs_type"), F.col("props").alias("payload"), F.col("event_type").alias("layer"), "ts")
    return E.upserted(e)


@query("WITH k AS (SELECT json_extract_string(props, '$.k') AS p, event_type AS layer FROM events), f AS (SELECT p, CASE WHEN count(DISTINCT layer) >= 3 OR count(*) >= 5 THEN 'INVARIANT' WHEN count(DISTINCT layer) >= 2 OR count(*) >= 3 THEN 'COMMON' ELSE 'EPHEMERAL' END AS stability, 'props' AS obs_type FROM k GROUP BY p) SELECT obs_type, stability, count(*) AS n FROM f GROUP BY CUBE (obs_type, stability)")
def kb_summary(s, d):
    return E.summary(_facts(s, d))


@query("WITH o AS (SELECT event_type AS struct_name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS off, user_id, event_id AS seq FROM events), l AS (SELECT struct_name, off, arg_max('u' || user_id, seq) AS name FROM o GROUP BY ALL) SELECT struct_name, count(*) AS n_fields, min(name) AS first_name FROM l GROUP BY struct_name")
def field_map(s, d):
    """Fields of each structure, the last name of each offset."""
    e = table(s, d, "events").select(F.col("event_type").alias("struct_name"), F.get_json_object("props", "$.k").cast("bigint").alias("offset"), F.concat(F.lit("u"), "user_id").alias("name"), F.col("event_id").alias("seq"))
    m = E.field_map(e)
    return m.select("struct_name", F.size("fields").alias("n_fields"), F.array_min(F.map_values("fields")).alias("first_name"))


@query(f"WITH {CONS} SELECT c.addr AS \"offset\", min(c.formula.lhs) AS name FROM cons WHERE c.addr IS NOT NULL GROUP BY 1 HAVING count(DISTINCT c.formula.lhs) = 1")
def unambiguous_fields(s, d):
    """Places that all constraints call by one name."""
    c = constraint_rows(s, d).filter("addr is not null")
    return E.unambiguous(c.select(F.col("addr").alias("offset"), F.col("lhs").alias("name")))


@query("SELECT cls_id, primary_algo IS NOT NULL AS matched, confidence FROM (SELECT *, row_number() OVER (PARTITION BY cls_id ORDER BY classified_ts DESC) AS rn FROM classify_result) WHERE rn = 1 AND confidence >= 0.65")
def confident_results(s, d):
    """Current classifications that are sure enough to be recorded as facts."""
    now = latest(table(s, d, "classify_result"), ["cls_id"], "classified_ts", ["primary_algo", "confidence"])
    return now.filter("confidence >= 0.65").select("cls_id", F.col("primary_algo").isNotNull().alias("matched"), "confidence")


@query("WITH t AS (SELECT DISTINCT ON (timing_id) * FROM constraint_timing ORDER BY timing_id, label NULLS FIRST, timed_out NULLS FIRST, both_sat NULLS FIRST), o AS (SELECT label, timed_out, both_sat, eval_ms FROM t) SELECT label, count(*) AS n, round(avg(CAST(timed_out AS INT)), 6) AS timeout_rate, round(avg(CAST(both_sat AS INT)), 6) AS both_sat_rate FROM o GROUP BY label")
def audit_rates(s, d):
    """How often the solver ran out of time, or found both sides possible."""
    t = table(s, d, "constraint_timing").groupBy("timing_id").agg(F.min(F.struct("label", "timed_out", "both_sat")).alias("r")).select("r.*")
    return rounded(t.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("timed_out").cast("double")).alias("timeout_rate"), F.avg(F.col("both_sat").cast("double")).alias("both_sat_rate")), "timeout_rate", "both_sat_rate")
