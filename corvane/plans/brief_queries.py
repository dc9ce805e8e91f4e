"""Queries over briefs, annotations, rankings of functions and roll-ups of evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import briefs as B
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import graph_local as L
from ..operators import incidence as I
from ..operators import iomap as M
from ..operators import patterns as P
from ..operators import probing as Q
from ..operators import textfeat as X
from ..functions import addresses
from ..sources.relations import call_lists, constraint_rows, global_reads, io_map, observations, rounded
from ..sources.tables import current_functions, table
from .corpus_queries import _ARCH, _CONST, NOW, RULES, _mined
from .graph_queries import _TIED, _WL, GRAPH, _inner, _refined
from .io_queries import CLUSTERS, CONS, OBS, READS, _clustered, _times
from .lineage import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---- annotations

#: Names for the queries: offsets of fields, compared constants, constants of one meaning, and arguments of calls.
FIELDS = {0x10: "count", 0x18: "next", 0x20: "prev", 0xD1: "state"}
COMPARED = {0: "NONE", 10: "LIMIT", 255: "BYTE_MAX"}
SENTINELS = {"0xffffffff": "INVALID", "0x9f": "MARK"}


@query(f"""WITH {NOW}, l AS (SELECT fn_id, pseudocode, list_filter(string_split(pseudocode, chr(10)), lambda x: regexp_matches(x, '^[^)]*\\(.*\\)'))[1] AS line FROM now), i AS (SELECT *, regexp_extract(line, '^[^(]*\\((.*)\\)', 1) AS a FROM l),
ch AS (SELECT fn_id, unnest(string_split(a, '')) AS c, generate_subscripts(string_split(a, ''), 1) AS p FROM i WHERE a <> ''), dp AS (SELECT fn_id, c, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY fn_id ORDER BY p) AS d FROM ch), k AS (SELECT fn_id, count(*) FILTER (c = ',' AND d = 0) AS k FROM dp GROUP BY fn_id)
SELECT fn_id, CASE WHEN pseudocode IS NULL THEN NULL WHEN line IS NULL THEN 1 WHEN lower(trim(a)) IN ('', 'void') THEN 0 ELSE 1 + k END AS n_arguments FROM i LEFT JOIN k USING (fn_id)""")
def argument_counts(s, d):
    """Arguments in the signature of each body."""
    return current_functions(s, d, ["pseudocode"]).select("fn_id", A.argument_count(F.col("pseudocode")).alias("n_arguments"))


def _noted(sql: str) -> str:
    return f"WITH {NOW} SELECT fn_id, md5({sql}) AS digest, {sql} <> pseudocode AS changed FROM now WHERE pseudocode IS NOT NULL"


def _digest(s, d, note):
    now = current_functions(s, d, ["pseudocode"]).filter("pseudocode is not null")
    out = note(F.col("pseudocode"))
    return now.select("fn_id", F.md5(out).alias("digest"), (out != F.col("pseudocode")).alias("changed"))


def _nested(start: str, parts: list[tuple[str, str]]) -> str:
    for pattern, into in parts:
        start = f"regexp_replace({start}, '{pattern}', '{into}', 'g')"
    return start


@query(_noted(_nested("pseudocode", [(rf"(?i)(\+\s*)(0x{o:x})(\s*[\),])", rf"\1\2 /* ->{n} */\3") for o, n in sorted(FIELDS.items())])))
def field_notes(s, d):
    """Bodies with the names of fields behind their offsets."""
    return _digest(s, d, lambda t: A.field_notes(t, FIELDS))


@query(_noted(_nested("pseudocode", [(rf"([!=]=\s*)(0[xX]0*(?i:{v:x})|0*{v})\b", rf"\1\2 /* {n} */") for v, n in sorted(COMPARED.items())])))
def comparison_notes(s, d):
    """Bodies with the names of the constants that values are compared with."""
    return _digest(s, d, lambda t: A.comparison_notes(t, COMPARED))


@query(_noted(_nested("pseudocode", [(rf"(?i)\b{k}\b", f"{k} /* {n} */") for k, n in sorted(SENTINELS.items())])))
def sentinel_notes(s, d):
    """Bodies with the names of constants that mean one thing anywhere."""
    return _digest(s, d, lambda t: A.sentinel_notes(t, SENTINELS))


@query()
def call_arguments(s, d):
    """Arguments of some helper calls in the bodies, by position and value."""
    names = ["LOCK", "UNLOCK", "CONCAT44", "memcpy", "ZEXT48", "SUB84", "memset", "free", "malloc"]
    return A.call_arguments(current_functions(s, d, ["pseudocode"]), "fn_id", "pseudocode", names)


@query(f"WITH {NOW}, {_CONST}, dict AS (SELECT DISTINCT c.formula.rhs_const AS v, op AS name FROM (SELECT unnest(constraints) AS c, unnest(constraints).formula.op AS op FROM exec_result) WHERE c.formula.rhs_const IS NOT NULL AND op IS NOT NULL) SELECT fn_id, v, name, c AS n FROM kept JOIN dict USING (v)")
def known_constants(s, d):
    """Constants of bodies that constraints compare something with, and how."""
    now = current_functions(s, d, ["pseudocode"])
    own = now.select("fn_id", F.explode(F.when(F.length("pseudocode") >= 20, X.constants(F.col("pseudocode")))).alias("v")).groupBy("fn_id", "v").agg(F.count("*").alias("n"))
    words = table(s, d, "exec_result").select(F.explode("constraints").alias("c")).select(F.col("c.formula.rhs_const").alias("value"), F.col("c.formula.op").alias("name"))
    return A.named_constants(own, words).select("fn_id", "v", "name", "n")


@query(f"WITH {NOW} SELECT fn_id, CAST('0x' || substring(md5(name), 1, 8) AS BIGINT) AS h FROM now")
def stable_hashes(s, d):
    return current_functions(s, d, ["name"]).select("fn_id", A.stable_hash(F.col("name")).alias("h"))


@query("SELECT confidence, count(*) AS n FROM (SELECT DISTINCT exec_id, CASE WHEN len(coalesce(silent_guesses, [])) > 0 OR len(coalesce(unimpl_ops, [])) > 0 THEN 'LOW' WHEN len(coalesce(stub_calls, [])) > 0 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM exec_result) GROUP BY confidence")
def execution_confidence(s, d):
    """How far runs can be trusted: those with guesses, with stubs only, and the rest."""
    c = A.execution_confidence(F.col("silent_guesses"), F.col("unimpl_ops"), F.lit(None).cast("array<string>"), F.col("stub_calls"))
    return table(s, d, "exec_result").select("exec_id", c.alias("confidence")).distinct().groupBy("confidence").agg(F.count("*").alias("n"))


# ---- briefs


@query(f"""WITH {_ARCH}, {RULES}, n AS (SELECT archetype, count(*) AS n FROM typed GROUP BY archetype), own AS (SELECT p.rule_id, t.archetype FROM present p JOIN typed t USING (fn_id)), o AS (SELECT rule_id, count(*) / (SELECT count(*) FROM typed) AS o FROM own GROUP BY rule_id),
lf AS (SELECT archetype, rule_id, round(count(*) / any_value(n) - any_value(o), 6) AS value FROM own JOIN n USING (archetype) JOIN o USING (rule_id) GROUP BY ALL), b AS (SELECT archetype, label, count(*) AS c FROM typed GROUP BY ALL)
SELECT archetype, 'size' AS kind, 1 AS rank, 'n' AS item, CAST(n AS DOUBLE) AS value FROM n
UNION ALL SELECT * FROM (SELECT archetype, 'binary', row_number() OVER (PARTITION BY archetype ORDER BY c DESC, label) AS r, label, CAST(c AS DOUBLE) FROM b) WHERE r <= 5
UNION ALL SELECT * FROM (SELECT archetype, 'rule', row_number() OVER (PARTITION BY archetype ORDER BY value DESC, rule_id) AS r, CAST(rule_id AS VARCHAR), value FROM lf) WHERE r <= 5
UNION ALL SELECT * FROM (SELECT archetype, 'example', row_number() OVER (PARTITION BY archetype ORDER BY fn_id) AS r, CAST(fn_id AS VARCHAR), NULL FROM typed) WHERE r <= 3""")
def cluster_profile(s, d):
    """Size, binaries, rules that stand out, and examples of each archetype."""
    ops, rules = _mined(s, d)
    members = cut(ops.select("label", "fn_id", P.archetype(F.array_join("tokens", " ")).alias("archetype")))
    return B.cluster_profile(members, P.presence(ops, rules), "archetype")


@query(_WL + """, g AS (SELECT wl2, count(*) AS n FROM w2 GROUP BY wl2 HAVING count(*) >= 100), lab AS (SELECT node, wl2, wl0 FROM w2 JOIN w0 USING (node)),
m AS (SELECT wl2, wl0 AS modal FROM (SELECT wl2, wl0, row_number() OVER (PARTITION BY wl2 ORDER BY count(*) DESC, wl0) AS r FROM lab GROUP BY wl2, wl0) WHERE r = 1),
c AS (SELECT l.wl2, coalesce(t.wl0, 'EXTERNAL') AS callee, count(*) AS k FROM edges e JOIN lab l ON l.node = e.src JOIN g ON g.wl2 = l.wl2 LEFT JOIN w0 t ON t.node = e.dst GROUP BY ALL),
r AS (SELECT wl2, callee, k / sum(k) OVER (PARTITION BY wl2) AS share, row_number() OVER (PARTITION BY wl2 ORDER BY k DESC, callee) AS rank FROM c)
SELECT g.wl2, g.n, modal, rank, callee, round(share, 6) AS share FROM g JOIN m USING (wl2) LEFT JOIN (SELECT * FROM r WHERE rank <= 4) r ON r.wl2 = g.wl2""")
def wl_groups(s, d):
    """Large groups of functions with like surroundings: what they are and what they call."""
    wl, _, edges = _refined(s, d)
    return rounded(B.group_analysis(wl.select("node", "wl2", "wl0"), edges, "wl2", "wl0"), "share")


@query(_WL + """, g AS (SELECT wl2, count(*) AS n FROM w2 GROUP BY wl2 HAVING count(*) >= 20), lab AS (SELECT node, wl2, wl0 FROM w2 JOIN w0 USING (node)),
m AS (SELECT wl2, wl0 AS modal FROM (SELECT wl2, wl0, row_number() OVER (PARTITION BY wl2 ORDER BY count(*) DESC, wl0) AS r FROM lab GROUP BY wl2, wl0) WHERE r = 1),
c AS (SELECT l.wl2, coalesce(t.wl0, 'EXTERNAL') AS callee, count(*) AS k FROM edges e JOIN lab l ON l.node = e.src JOIN g ON g.wl2 = l.wl2 LEFT JOIN w0 t ON t.node = e.dst GROUP BY ALL), z AS (SELECT wl2, count(*) AS z, arg_max(callee, k) AS top FROM c GROUP BY wl2)
SELECT g.wl2, CASE WHEN z IS NULL THEN 'LEAF_' || substring(modal, 1, 8) WHEN z = 1 THEN substring(modal, 1, 6) || '→' || substring(top, 1, 6) ELSE substring(modal, 1, 8) || '_MIXED' END AS name FROM g JOIN m USING (wl2) LEFT JOIN z USING (wl2)""")
def wl_names(s, d):
    """Names of groups of at least twenty functions, from what they are and what they call."""
    wl, _, edges = _refined(s, d)
    g = B.group_analysis(wl.select("node", "wl2", "wl0"), edges, "wl2", "wl0", least=20)
    top = F.array_sort(F.collect_list(F.when(F.col("callee").isNotNull(), F.struct("rank", F.col("callee").alias("label"), "share"))))
    return g.groupBy("wl2", "modal").agg(top.alias("t")).select("wl2", G.pattern_name(F.col("modal"), F.col("t")).alias("name"))


@query(f"WITH {NOW}, c AS (SELECT fn_id, label, CASE WHEN size IS NULL THEN -1 WHEN size < 10 THEN 0 WHEN size < 50 THEN 1 WHEN size < 200 THEN 2 ELSE 3 END AS cluster FROM now) SELECT label, CASE cluster WHEN -1 THEN 'NOISE' WHEN 0 THEN 'GETTER' WHEN 1 THEN 'GUARD_SIMPLE' ELSE 'C' || cluster END AS archetype, count(*) AS n FROM c GROUP BY ALL")
def cluster_names(s, d):
    """Functions of each binary by the name of their cluster (here by size), unnamed ones by number."""
    size = F.col("size")
    cluster = F.when(size.isNull(), -1).when(size < 10, 0).when(size < 50, 1).when(size < 200, 2).otherwise(3)
    now = current_functions(s, d, ["label", "size"])
    return now.groupBy("label", B.cluster_name(cluster, {0: "GETTER", 1: "GUARD_SIMPLE"}).alias("archetype")).agg(F.count("*").alias("n"))


@query(f"""WITH {_ARCH}, {RULES}, cover AS (SELECT corpus.label, corpus.fn_id, count(rule_id) / (SELECT count(*) FROM rules) AS coverage FROM corpus LEFT JOIN present USING (label, fn_id) GROUP BY ALL)
SELECT label, fn_id, archetype, round(coverage, 6) AS coverage, len(tokens) AS size FROM typed JOIN cover USING (label, fn_id) JOIN corpus USING (label, fn_id)""")
def brief_rows(s, d):
    """Each function with its archetype, coverage and size: the rows of a brief."""
    ops, rules = _mined(s, d)
    typed = ops.select("label", "fn_id", P.archetype(F.array_join("tokens", " ")).alias("archetype"), F.size("tokens").alias("size"))
    c = P.coverage(P.presence(ops, rules), ops, rules).select("fn_id", "coverage")
    return rounded(typed.join(c, "fn_id", "left").select("label", "fn_id", "archetype", "coverage", "size"), "coverage")


_BAND = "CASE WHEN size >= 200 THEN 'large' WHEN size >= 50 THEN 'medium' ELSE 'small' END"


@query(f"WITH {NOW}, b AS (SELECT label, fn_id, size, {_BAND} AS band FROM now WHERE size IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY label, band ORDER BY size DESC, fn_id) AS rank FROM b) SELECT * FROM r WHERE rank <= CASE band WHEN 'large' THEN 5 WHEN 'medium' THEN 3 ELSE 2 END")
def compact_packet(s, d):
    """The largest functions of each binary, five, three and two by band."""
    size = F.col("size")
    rows = current_functions(s, d, ["label", "size"]).filter("size is not null").withColumn("band", F.when(size >= 200, "large").when(size >= 50, "medium").otherwise("small"))
    return B.bands(rows, ["label"], "band", [F.desc("size"), F.col("fn_id")], {"large": 5, "medium": 3, "small": 2})


@query(f"WITH {NOW}, r AS (SELECT label, fn_id, size, cyclomatic_approx, row_number() OVER (PARTITION BY label ORDER BY size DESC NULLS LAST, fn_id) AS by_size, row_number() OVER (PARTITION BY label ORDER BY cyclomatic_approx DESC NULLS LAST, fn_id) AS by_complexity FROM now) SELECT * FROM r WHERE by_size <= 10 OR by_complexity <= 10")
def listings(s, d):
    """The ten largest and the ten most complex functions of each binary."""
    from pyspark.sql.window import Window

    now = current_functions(s, d, ["label", "size", "cyclomatic_approx"])
    w = Window.partitionBy("label")
    r = now.withColumn("by_size", F.row_number().over(w.orderBy(F.desc_nulls_last("size"), "fn_id"))).withColumn("by_complexity", F.row_number().over(w.orderBy(F.desc_nulls_last("cyclomatic_approx"), "fn_id")))
    return r.filter("by_size <= 10 or by_complexity <= 10").select("label", "fn_id", "size", "cyclomatic_approx", "by_size", "by_complexity")


@query(f"WITH {CLUSTERS}, a AS (SELECT label, avg(CAST(\"offset\" % 4 = 0 AS INT)) AS t3, count(*) AS n_globals, count(DISTINCT cluster) AS n_clusters FROM cl GROUP BY label), l AS (SELECT label, 't3' AS metric, CAST(t3 AS DOUBLE) AS v FROM a UNION ALL SELECT label, 'n_globals', n_globals FROM a UNION ALL SELECT label, 'n_clusters', n_clusters FROM a) SELECT metric, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(max(v) - min(v), 6) AS spread, min(label) FILTER (v = lo) AS at_lowest, min(label) FILTER (v = hi) AS at_highest FROM (SELECT *, min(v) OVER (PARTITION BY metric) AS lo, max(v) OVER (PARTITION BY metric) AS hi FROM l) GROUP BY metric")
def binary_comparison(s, d):
    """How far binaries are apart in the geometry of their globals."""
    _, clusters = _clustered(s, d)
    a = clusters.groupBy("label").agg(F.avg((F.col("offset") % 4 == 0).cast("double")).alias("t3"), F.count("*").alias("n_globals"), F.count_distinct("cluster").alias("n_clusters"))
    return rounded(B.comparison(a, "label", ["t3", "n_globals", "n_clusters"]), "lowest", "highest", "spread")


# ---- rankings

_NOISE = f"""{GRAPH}, seed AS (SELECT node FROM nodes WHERE depth = 0), b(node) AS (SELECT node FROM seed UNION SELECT de.dst FROM b JOIN de ON de.src = b.node), big AS (SELECT label, count(*) AS n FROM now GROUP BY label),
nc AS (SELECT fn_id, label, unnest(named_callees) AS c FROM now), ref AS (SELECT label, c, count(*) AS k FROM nc WHERE c IS NOT NULL GROUP BY ALL),
lib AS (SELECT fn_id, bool_and(log2(big.n / k) < 0.65 * log2(greatest(big.n, 2))) AS lib FROM nc JOIN ref USING (label, c) JOIN big USING (label) WHERE NOT starts_with(c, 'FUN_') GROUP BY fn_id)"""


def _noise(s, d, nodes, edges):
    now = current_functions(s, d, ["label", "named_callees"])
    dist = L.walks(nodes.withColumn("seed", F.col("depth") == 0), edges, "seed")
    return G.noise(now, dist)


@query(f"WITH RECURSIVE {_NOISE} SELECT nodes.node, nodes.node NOT IN (SELECT node FROM b) AS unreachable, coalesce(lib, false) AS common_only FROM nodes LEFT JOIN lib ON lib.fn_id = nodes.node")
def noise_flags(s, d):
    """Functions that no seed reaches, and those that call widely used names only."""
    return _noise(s, d, *_inner(s, d))


@query()
def graph_rank(s, d):
    """The twenty functions of each binary most worth a look, with noise left out."""
    nodes, edges = _inner(s, d)
    r = cut(G.betweenness(nodes, edges)).join(G.degrees(nodes, edges, True), "node").join(_noise(s, d, nodes, edges), "node").join(nodes.select("node", "label", "size", "depth"), "node")
    rank = G.graph_rank(F.col("betweenness"), F.coalesce("size", F.lit(1)), F.col("n_in"), F.col("unreachable") | F.col("common_only"), F.col("depth") == 0)
    scored = r.filter(~F.col("unreachable") & ~F.col("common_only")).select("label", "node", F.round(rank, 9).alias("graph_rank"))
    return P.top_per_group(scored, ["label"], [F.desc("graph_rank"), F.col("node")], 20)


@query()
def central_functions(s, d):
    """The five functions of each binary with most page rank, authority and flow, and what sets rank and flow apart."""
    nodes, edges = _inner(s, d)
    m = G.pagerank(nodes, edges).join(G.hits(nodes, edges), "node").join(G.betweenness(nodes, edges), "node")
    top = m.agg(F.max("rank").alias("_r"), F.max("betweenness").alias("_b"))
    m = m.join(F.broadcast(top)).withColumn("pr_bet_div", F.col("rank") / F.col("_r") - F.coalesce(F.col("betweenness") / F.nullif(F.col("_b"), F.lit(0.0)), F.lit(0.0)))
    m = cut(m.join(nodes.select("node", "label"), "node"))
    out = None
    for kind in ("rank", "authority", "betweenness"):
        part = P.top_per_group(m.select("label", "node", F.lit(kind).alias("kind"), F.round(kind, 9).alias("value"), F.round("pr_bet_div", 6).alias("pr_bet_div")), ["label"], [F.desc("value"), F.col("node")], 5, "place")
        out = part if out is None else out.unionByName(part)
    return out


_CLS = "CASE WHEN size < 10 THEN 'TINY' WHEN size < 50 THEN 'SMALL' WHEN size < 200 THEN 'MEDIUM' WHEN size < 1000 THEN 'LARGE' ELSE 'MONOLITH' END"


@query(f"""WITH RECURSIVE {_TIED}, N AS (SELECT count(*) AS n FROM nodes), cls AS (SELECT node, {_CLS} AS cls FROM nodes), ncls AS (SELECT greatest(count(DISTINCT cls), 2) AS k FROM cls), ncomp AS (SELECT greatest(count(*), 2) AS k FROM sized),
w1 AS (SELECT dst AS node, comp AS g, count(*) AS c FROM inner_ JOIN wc ON wc.node = src GROUP BY ALL), h1 AS (SELECT node, sum(-(c / t) * log2(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY node) AS t FROM w1) GROUP BY node),
w2 AS (SELECT dst AS node, cls AS g, count(*) AS c FROM inner_ JOIN cls ON cls.node = src GROUP BY ALL), h2 AS (SELECT node, sum(-(c / t) * log2(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY node) AS t FROM w2) GROUP BY node),
ref AS (SELECT dst, log2((SELECT n FROM N) / count(*)) AS idf FROM inner_ GROUP BY dst), mi AS (SELECT src AS node, avg(idf) AS m FROM inner_ JOIN ref USING (dst) GROUP BY src),
u AS (SELECT node, caller_count, m, log2(greatest((SELECT n FROM N), 2)) AS top, greatest(coalesce(h2.h, 0) / log2((SELECT k FROM ncls)), coalesce(h1.h, 0) / log2((SELECT k FROM ncomp))) AS div FROM nodes LEFT JOIN h1 USING (node) LEFT JOIN h2 USING (node) LEFT JOIN mi USING (node)),
v AS (SELECT *, 0.30 * least(caller_count / greatest((SELECT n FROM N) * 0.05, 1), 1.0) + 0.40 * CASE WHEN m IS NULL THEN 0.5 ELSE 1 - m / top END + 0.30 * div AS raw FROM u)
SELECT node, round(CASE WHEN coalesce(caller_count, 0) = 0 THEN 0 WHEN coalesce(m, 0) > top * 0.60 THEN least(raw, 0.30) ELSE raw END, 5) AS utility FROM v""")
def utility_score(s, d):
    """How much a function is a helper of all: many and diverse callers, ordinary callees."""
    nodes, edges = _inner(s, d)
    nodes = cut(nodes.withColumn("cls", X.size_class(F.col("size"))).join(L.component_names(nodes, edges), "node"))
    return rounded(G.utility(nodes, edges, "comp", "cls", "caller_count"), "utility", digits=5)


# ---- classification


@query()
def admitted_matches(s, d):
    """Matches with reference functions that the metrics of a function admit."""
    io = cut(io_map(s, d))
    found = M.filtered_matches(M.reference_matches(io), M.metrics(io, _times(s, d)))
    return rounded(found.filter("score > 0"), "score")


@query()
def classified(s, d):
    """Class of each probed function, with a full match of an admitted reference function above the ladder, and the share of constants that constraints know."""
    io = cut(io_map(s, d))
    m = cut(M.metrics(io, _times(s, d)))
    best = M.best_match(M.filtered_matches(M.reference_matches(io), m), list(M.REFERENCE_FUNCTIONS))
    return rounded(M.resolved_class(m, best), "confidence")


# ---- evidence and roll-ups


@query(f"WITH {OBS}, n AS (SELECT count(DISTINCT session) AS n FROM obs), g AS (SELECT addr_key, value, count(DISTINCT session) AS k FROM obs GROUP BY ALL) SELECT addr_key, value FROM g, n WHERE k / n >= 0.75")
def stable_facts(s, d):
    """Observations of at least the middle tier."""
    st = E.session_stability(observations(s, d)).withColumn("stability", F.when(F.col("stability") == "UNIQUE", "EPHEMERAL").otherwise(F.col("stability")))
    return E.at_least(st, "COMMON").select("addr_key", "value")


@query(f"WITH {NOW} SELECT count(*) AS n, count(name) AS named, count(*) FILTER (pseudocode IS NULL) AS errors, round(avg(size), 6) AS mean_score, list(size ORDER BY size)[count(size) // 2 + 1] AS median_score FROM now")
def status_rollup(s, d):
    """Functions, named ones, those without a body, and their sizes."""
    now = current_functions(s, d, ["name", "pseudocode", "size"])
    return rounded(Q.status_rollup(now.select("name", F.when(F.col("pseudocode").isNull(), "no body").alias("error"), F.col("size").alias("score"))), "mean_score")




@query(f"WITH {CLUSTERS}, big AS (SELECT label, cluster FROM cl GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT label AS key, count(DISTINCT addr) AS n_globals, count(DISTINCT fn) AS n_fns FROM reads GROUP BY label), b AS (SELECT label AS key, count(*) AS n_clusters FROM big GROUP BY label), c AS (SELECT DISTINCT label AS key FROM (SELECT label, unnest(constraints) AS c FROM exec_result) WHERE c IS NOT NULL AND c.formula IS NOT NULL) SELECT key, 'one function only' AS rule, 'WARN' AS severity FROM k WHERE n_fns = 1 UNION ALL SELECT key, 'reads without constraints', 'INFO' FROM k WHERE key NOT IN (SELECT key FROM c WHERE key IS NOT NULL) UNION ALL SELECT key, 'globals without clusters', 'WARN' FROM k LEFT JOIN b USING (key) WHERE coalesce(n_clusters, 0) = 0")
def report_guards(s, d):
    """Rules of data quality that the binaries' reports break; a cluster here has two globals at least."""
    reads, clusters = _clustered(s, d)
    k = reads.groupBy(F.col("label").alias("key")).agg(F.count_distinct("addr").alias("n_globals"), F.count_distinct("fn").alias("n_fns"))
    big = clusters.groupBy("label", "cluster").agg(F.count("*").alias("n")).filter("n >= 2").groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n_clusters"))
    c = constraint_rows(s, d).groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n_constraints"))
    return Q.guards(k.join(big, "key", "left").join(c, "key", "left").na.fill(0, ["n_constraints", "n_clusters"]))


@query("SELECT label, va FROM (SELECT DISTINCT label, lower(trim(va)) AS va FROM retired_function WHERE va IS NOT NULL AND label IS NOT NULL) WHERE (label, va) NOT IN (SELECT label, lower(trim(va)) FROM calltree WHERE va IS NOT NULL AND label IS NOT NULL)")
def unknown_references(s, d):
    """Withdrawn addresses, as they are spelled, that no function has: references without a record."""
    spelled = lambda df: df.select("label", F.lower(F.trim("va")).alias("va")).dropna().distinct()
    return spelled(table(s, d, "retired_function")).join(spelled(table(s, d, "calltree")), ["label", "va"], "left_anti")


@query("WITH e AS (SELECT user_id % 10 AS session, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS r FROM events) SELECT session, count(*) AS n, list(event_id ORDER BY r) FILTER (r <= 10) AS first_ids FROM e GROUP BY session")
def session_summary(s, d):
    """Observations of each session, and the first ten."""
    o = observations(s, d).select("session", "seq")
    first = P.top_per_group(o, ["session"], [F.col("seq")], 10).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "seq"))), lambda x: x["seq"]).alias("first_ids"))
    return o.groupBy("session").agg(F.count("*").alias("n")).join(first, "session")


@query("WITH f AS (SELECT label AS base_label, CAST(e.key AS BIGINT) AS addr, e.value AS size, exec_id FROM (SELECT label, exec_id, unnest(map_entries(global_reads)) AS e FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY run_ts DESC, va DESC) AS rn FROM exec_result WHERE global_reads IS NOT NULL) WHERE rn = 1))) SELECT addr // 4096 AS base, addr % 4096 AS \"offset\", max(size) AS size, count(DISTINCT exec_id) AS n_fns FROM f WHERE addr >= 0 GROUP BY ALL")
def indirect_fields(s, d):
    """Fields behind page bases: their greatest size and how many functions read them."""
    r = global_reads(s, d).filter("addr >= 0")
    return I.indirect_map(r.select("fn", F.floor(F.col("addr") / 4096).alias("base"), (F.col("addr") % 4096).alias("offset"), "size"))


@query("SELECT DISTINCT p.event_type AS event_type, a.user_id AS a, b.user_id AS b FROM (SELECT DISTINCT event_type FROM events) p JOIN (SELECT DISTINCT event_type, user_id FROM events) a USING (event_type) JOIN (SELECT DISTINCT event_type, user_id FROM events) b USING (event_type) WHERE a.user_id <> b.user_id AND a.user_id + b.user_id = 100")
def candidate_pairs(s, d):
    """Users of one kind of event whose numbers add up to a hundred: pairs that a predicate picks."""
    v = table(s, d, "events").select("event_type", F.col("user_id").alias("value"))
    return Q.candidate_pairs(v, "event_type", F.lit(100) - F.col("value"))


@query("SELECT retval, row_number() OVER (ORDER BY CASE WHEN retval < 0 THEN CAST(retval AS HUGEINT) + 18446744073709551616 ELSE retval END) AS place FROM (SELECT DISTINCT retval FROM execute_result WHERE retval IS NOT NULL AND (retval < 0 OR retval > 4611686018427387904))")
def unsigned_order(s, d):
    """Results beyond 62 bits in the order of their unsigned values."""
    from .numbering import numbered

    v = table(s, d, "execute_result").select("retval").filter("retval is not null and (retval < 0 or retval > 4611686018427387904)").distinct()
    return numbered(v, [addresses.unsigned_order(F.col("retval"))], "_n").select("retval", (F.col("_n") + 1).alias("place"))
