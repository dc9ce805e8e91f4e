"""Queries over call graphs, each with its SQL; iterative ones on graphs small enough for SQL to recurse have it too."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import entropy_of, ladder
from ..operators import graph as G
from ..operators import graph_local as L
from ..sources.relations import call_lists, call_targets, part_graph, rounded
from ..sources.tables import current_functions, table
from .corpus_queries import NOW
from .lineage import cut

HEX = r"TRY_CAST('0x' || regexp_extract({0}, '^\s*(?:0[xX])?0*([0-9a-fA-F]{{1,15}})\s*$', 1) AS BIGINT)"
GRAPH = NOW + f""", nodes AS (SELECT fn_id AS node, label, name, size, depth, caller_count, {HEX.format("va")} AS addr FROM now),
calls AS (SELECT src, label, addr FROM (SELECT fn_id AS src, label, {HEX.format("t")} AS addr FROM (SELECT fn_id, label, unnest(called_vas) AS t FROM now)) WHERE addr IS NOT NULL),
edges AS (SELECT c.src, n.node AS dst FROM calls c LEFT JOIN nodes n ON n.label = c.label AND n.addr = c.addr), inner_ AS (SELECT * FROM edges WHERE dst IS NOT NULL), de AS (SELECT DISTINCT * FROM inner_)"""
PARTS = "edges AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL), nodes AS (SELECT p_partkey AS node, p_brand, p_size FROM part), de AS (SELECT DISTINCT * FROM edges)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _inner(s, d):
    nodes, edges = call_lists(s, d)
    return cut(nodes), cut(edges.filter("dst is not null"))


_DEG = "o AS (SELECT src AS node, count(*) AS n_out FROM {e} GROUP BY src), i AS (SELECT dst AS node, count(*) AS n_in FROM {e} GROUP BY dst) SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM nodes LEFT JOIN o USING (node) LEFT JOIN i USING (node)"


@query(f"WITH {GRAPH}, {_DEG.format(e='inner_')}")
def degree(s, d):
    nodes, edges = call_lists(s, d)
    return G.degrees(nodes, edges.filter("dst is not null"))


@query(f"WITH {GRAPH}, {_DEG.format(e='de')}")
def degree_distinct(s, d):
    nodes, edges = call_lists(s, d)
    return G.degrees(nodes, edges.filter("dst is not null"), distinct=True)


@query(f"WITH {GRAPH}, anywhere AS (SELECT addr, min(node) AS g FROM nodes GROUP BY addr), res AS (SELECT c.src, coalesce(CAST(n.node AS VARCHAR), CAST(g.g AS VARCHAR), 'EXTERNAL') AS target FROM calls c LEFT JOIN nodes n ON n.label = c.label AND n.addr = c.addr LEFT JOIN anywhere g ON g.addr = c.addr) SELECT src, target, count(*) AS n FROM res GROUP BY ALL")
def callee_resolution(s, d):
    """Calls resolved within the binary, else by address in any binary (the least function), else EXTERNAL."""
    nodes, calls = call_targets(s, d)
    r = G.resolved(nodes, calls)
    return r.groupBy("src", F.coalesce(F.col("dst").cast("string"), F.lit("EXTERNAL")).alias("target")).agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT DISTINCT dst AS node, src AS caller FROM inner_")
def callers(s, d):
    _, edges = call_lists(s, d)
    return G.callers(edges.filter("dst is not null")).distinct().select(F.col("src").alias("node"), F.col("dst").alias("caller"))


@query(f"WITH {GRAPH} SELECT count(*) AS n_edges, count(b.src) AS n_reciprocal, round(count(b.src) / count(*), 6) AS share FROM de a LEFT JOIN de b ON a.src = b.dst AND a.dst = b.src")
def recip_edges(s, d):
    _, edges = call_lists(s, d)
    return rounded(G.reciprocal_share(edges.filter("dst is not null")), "share")


_UND = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst AND dst IS NOT NULL), k AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node)"


@query(f"WITH {PARTS}, {_UND}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), tn AS (SELECT node, count(*) AS triangles FROM (SELECT p AS node FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY node) SELECT node, coalesce(k, 0) AS k, coalesce(triangles, 0) AS triangles, round(CASE WHEN k >= 2 THEN 2.0 * coalesce(triangles, 0) / (k * (k - 1)) ELSE 0 END, 6) AS cc FROM nodes LEFT JOIN k USING (node) LEFT JOIN tn USING (node)")
def clustering_coef(s, d):
    return rounded(G.clustering(*part_graph(s, d)), "cc")


@query(f"""WITH {GRAPH}, n AS (SELECT count(*) AS n FROM nodes), ref AS (SELECT dst, log2((SELECT n FROM n) / count(*)) AS idf FROM inner_ GROUP BY dst), m AS (SELECT src AS node, avg(idf) AS m, max(idf) AS x FROM inner_ JOIN ref USING (dst) GROUP BY src)
SELECT node, round(coalesce(m, 0), 6) AS mean_idf, round(coalesce(x, 0), 6) AS max_idf, round(CASE WHEN m IS NULL THEN 0.5 ELSE 1 - m / log2((SELECT n FROM n)) END, 6) AS utility FROM nodes LEFT JOIN m USING (node)""")
def callee_idf(s, d):
    nodes, edges = _inner(s, d)
    return rounded(G.callee_idf(nodes, edges), "mean_idf", "max_idf", "utility")


_SIZE = "CASE WHEN size < 10 THEN 'TINY' WHEN size < 50 THEN 'SMALL' WHEN size < 200 THEN 'MEDIUM' WHEN size < 1000 THEN 'LARGE' ELSE 'MONOLITH' END"


def _sized(s, d):
    from ..operators.textfeat import size_class

    nodes, edges = _inner(s, d)
    return nodes.withColumn("cls", size_class(F.col("size"))), edges


@query(f"""WITH {GRAPH}, c AS (SELECT node, {_SIZE} AS cls FROM nodes), w AS (SELECT dst AS node, cls, count(*) AS c FROM de JOIN c ON c.node = de.src GROUP BY ALL), p AS (SELECT node, c, sum(c) OVER (PARTITION BY node) AS t FROM w), h AS (SELECT node, sum(-c / t * log2(c / t)) AS h, max(t) AS t FROM p GROUP BY node)
SELECT node, coalesce(t, 0) AS n_callers, round(coalesce(h, 0), 6) AS diversity FROM nodes LEFT JOIN h USING (node)""")
def caller_diversity(s, d):
    nodes, edges = _sized(s, d)
    return rounded(G.caller_diversity(nodes, edges, "cls"), "diversity")


@query(f"""WITH {GRAPH}, g AS (SELECT node, coalesce(n_out, 0) AS k FROM nodes LEFT JOIN (SELECT src AS node, count(*) AS n_out FROM inner_ GROUP BY src) USING (node)), n AS (SELECT k, count(*) AS c FROM g GROUP BY k), p AS (SELECT c / sum(c) OVER () AS p FROM n), s AS (SELECT list(k ORDER BY k) AS v, count(*) AS n FROM g)
SELECT n, round((SELECT sum(-p * log2(p)) FROM p), 6) AS entropy, v[least(n * 25 // 100, n - 1) + 1] AS p25, v[least(n * 50 // 100, n - 1) + 1] AS p50, v[least(n * 75 // 100, n - 1) + 1] AS p75, v[least(n * 95 // 100, n - 1) + 1] AS p95 FROM s""")
def degree_entropy(s, d):
    """Entropy and percentiles of the out-degree, from its histogram."""
    nodes, edges = call_lists(s, d)
    hist = G.degrees(nodes, edges.filter("dst is not null")).groupBy(F.col("n_out").alias("k")).agg(F.count("*").alias("c"))
    n = hist.agg(F.sum("c").alias("n"))
    cum = hist.join(F.broadcast(n)).withColumn("upto", F.sum("c").over(Window.orderBy("k")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("k"))).alias(f"p{p}")
    return rounded(cum.agg(F.max("n").alias("n"), entropy_of(F.col("c") / F.col("n")).alias("entropy"), at(25), at(50), at(75), at(95)), "entropy")


@query(f"WITH {NOW}, r AS (SELECT label, size, row_number() OVER (PARTITION BY label ORDER BY size, fn_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM now WHERE size IS NOT NULL) SELECT label, count(*) AS n, round(CASE WHEN sum(size) > 0 THEN sum(size * (2 * i - n - 1)) / (max(n) * sum(size)) ELSE 0 END, 6) AS gini FROM r GROUP BY label")
def size_gini(s, d):
    """Inequality of function sizes; ranks come from the sizes' histogram, so a large binary is no single task."""
    now = current_functions(s, d, ["label", "size"]).filter("size is not null")
    hist = now.groupBy("label", "size").agg(F.count("*").alias("c"))
    w = Window.partitionBy("label").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    r = hist.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    n = hist.groupBy("label").agg(F.sum("c").alias("n"))
    # the sum of 2 i - n - 1 over c equal values that follow `before` smaller ones
    part = F.col("c") * (2 * F.col("before") + F.col("c") - F.col("n"))
    g = r.join(n, "label").groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("size") * part).alias("s"), F.sum(F.col("size") * F.col("c")).alias("t"))
    return rounded(g.select("label", "n", F.when(F.col("t") > 0, F.col("s") / (F.col("n") * F.col("t"))).otherwise(F.lit(0.0)).alias("gini")), "gini")


@query(f"WITH {NOW} SELECT label, count(*) AS n, count(*) FILTER (size >= 1000) AS monoliths, count(*) FILTER (size < 10) AS tiny, count(*) FILTER (is_thunk) AS thunks, count(*) FILTER (is_recursive) AS recursive FROM now GROUP BY label")
def size_counts(s, d):
    now = current_functions(s, d, ["label", "size", "is_thunk", "is_recursive"])
    return now.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("size") >= 1000).alias("monoliths"), F.count_if(F.col("size") < 10).alias("tiny"), F.count_if("is_thunk").alias("thunks"), F.count_if("is_recursive").alias("recursive"))


_WL = f"""WITH {GRAPH}, w0 AS (SELECT node, {_SIZE} AS wl0 FROM nodes),
t1 AS (SELECT w0.node, wl0 || '|' || coalesce(n, '') AS t FROM w0 LEFT JOIN (SELECT e.src AS node, string_agg(coalesce(c.wl0, 'EXTERNAL'), ',' ORDER BY coalesce(c.wl0, 'EXTERNAL')) AS n FROM edges e LEFT JOIN w0 c ON c.node = e.dst GROUP BY e.src) USING (node)), w1 AS (SELECT node, 'L1_' || (dense_rank() OVER (ORDER BY t) - 1) AS wl1 FROM t1),
t2 AS (SELECT w1.node, wl1 || '|' || coalesce(n, '') AS t FROM w1 LEFT JOIN (SELECT e.src AS node, string_agg(coalesce(c.wl1, 'EXTERNAL'), ',' ORDER BY coalesce(c.wl1, 'EXTERNAL')) AS n FROM edges e LEFT JOIN w1 c ON c.node = e.dst GROUP BY e.src) USING (node)), w2 AS (SELECT node, 'L2_' || (dense_rank() OVER (ORDER BY t) - 1) AS wl2 FROM t2),
t3 AS (SELECT w2.node, wl2 || '|' || coalesce(n, '') AS t FROM w2 LEFT JOIN (SELECT e.src AS node, string_agg(coalesce(c.wl2, 'EXTERNAL'), ',' ORDER BY coalesce(c.wl2, 'EXTERNAL')) AS n FROM edges e LEFT JOIN w2 c ON c.node = e.dst GROUP BY e.src) USING (node)), w3 AS (SELECT node, 'L3_' || (dense_rank() OVER (ORDER BY t) - 1) AS wl3 FROM t3)"""


def _refined(s, d):
    from ..operators.textfeat import size_class

    nodes, edges = call_lists(s, d)
    return G.refine(nodes.withColumn("wl0", size_class(F.col("size"))), edges, "wl0", 3), nodes, edges


@query(_WL + " SELECT node, wl0, wl1, wl2, wl3 FROM w0 JOIN w1 USING (node) JOIN w2 USING (node) JOIN w3 USING (node)")
def wl_labels(s, d):
    """Labels refined three times by the labels of the callees."""
    return _refined(s, d)[0].select("node", "wl0", "wl1", "wl2", "wl3")


@query(_WL + ", n AS (SELECT wl1, count(*) AS n FROM w1 GROUP BY wl1) SELECT wl1, n, row_number() OVER (ORDER BY n DESC, wl1) AS rank FROM n ORDER BY n DESC, wl1 LIMIT 5")
def wl_top(s, d):
    """The five most frequent labels of the first refinement: a top-k report."""
    n = _refined(s, d)[0].groupBy("wl1").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "wl1").limit(5)
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "wl1")))


@query(_WL + """, g AS (SELECT wl1, label, count(*) AS n FROM w1 JOIN nodes USING (node) GROUP BY ALL), c AS (SELECT wl1, sum(n) AS cnt FROM g GROUP BY wl1), r AS (SELECT label, count(*) / (SELECT count(*) FROM nodes) AS rate FROM nodes GROUP BY label)
SELECT wl1, label, n, round(n / cnt / rate, 6) AS enrichment FROM g JOIN c USING (wl1) JOIN r USING (label) WHERE n / cnt / rate > 3 AND n > 2""")
def wl_enrichment(s, d):
    """Labels that gather in one binary."""
    wl, nodes, _ = _refined(s, d)
    g = wl.select("node", "wl1").join(nodes.select("node", "label"), "node").groupBy("wl1", "label").agg(F.count("*").alias("n"))
    c = g.groupBy("wl1").agg(F.sum("n").alias("cnt"))
    total = nodes.agg(F.count("*").alias("all"))
    r = nodes.groupBy("label").agg(F.count("*").alias("k")).join(F.broadcast(total)).select("label", (F.col("k") / F.col("all")).alias("rate"))
    return rounded(g.join(c, "wl1").join(r, "label").withColumn("enrichment", F.col("n") / F.col("cnt") / F.col("rate")).filter("enrichment > 3 and n > 2").select("wl1", "label", "n", "enrichment"), "enrichment")


@query(f"WITH {GRAPH}, i AS (SELECT node, label, node NOT IN (SELECT src FROM edges) AND node NOT IN (SELECT dst FROM inner_) AS isolated FROM nodes) SELECT label, count(*) FILTER (isolated) AS isolated, count(*) AS n, round(100 * avg(CAST(isolated AS INT)), 6) AS pct FROM i GROUP BY label")
def isolated(s, d):
    """Functions without calls either way, by binary."""
    nodes, edges = call_lists(s, d)
    ends = edges.select(F.col("src").alias("node")).union(edges.filter("dst is not null").select("dst")).distinct().withColumn("_e", F.lit(1))
    i = nodes.select("node", "label").join(ends, "node", "left").withColumn("isolated", F.col("_e").isNull())
    return rounded(i.groupBy("label").agg(F.count_if("isolated").alias("isolated"), F.count("*").alias("n"), (100 * F.avg(F.col("isolated").cast("double"))).alias("pct")), "pct")


@query(f"""WITH RECURSIVE {GRAPH}, seed AS (SELECT node FROM nodes WHERE depth = 0), b(node, dist) AS (SELECT node, 0 FROM seed UNION SELECT de.dst, b.dist + 1 FROM b JOIN de ON de.src = b.node WHERE b.dist < 80), m AS (SELECT node, min(dist) AS dist FROM b GROUP BY node) SELECT node, coalesce(dist, -1) AS dist FROM nodes LEFT JOIN m USING (node)""")
def bfs_distance(s, d):
    """Calls from the nearest function that was dumped at depth 0."""
    nodes, edges = _inner(s, d)
    return L.walks(nodes.withColumn("seed", F.col("depth") == 0), edges, "seed")


_WAYS = GRAPH + """, way(a, b) AS (SELECT src, dst FROM de UNION SELECT way.a, de.dst FROM way JOIN de ON de.src = way.b),
grp AS (SELECT n.node, least(n.node, coalesce(min(x.b), n.node)) AS scc FROM nodes n LEFT JOIN (SELECT p.a, p.b FROM way p JOIN way q ON p.a = q.b AND p.b = q.a) x ON x.a = n.node GROUP BY n.node),
ge AS (SELECT DISTINCT p.scc AS a, q.scc AS b FROM de JOIN grp p ON p.node = de.src JOIN grp q ON q.node = de.dst WHERE p.scc <> q.scc),
far(scc, d) AS (SELECT DISTINCT scc, 0 FROM grp UNION SELECT ge.b, d + 1 FROM far JOIN ge ON ge.a = far.scc), deep AS (SELECT scc, max(d) AS rank FROM far GROUP BY scc)"""
_TIED = GRAPH + """, eachway AS (SELECT src, dst FROM de UNION SELECT dst, src FROM de), tied(a, b) AS (SELECT node, node FROM nodes UNION SELECT tied.a, eachway.dst FROM tied JOIN eachway ON eachway.src = tied.b),
wc AS (SELECT a AS node, min(b) AS comp FROM tied GROUP BY a), sized AS (SELECT comp, count(*) AS n FROM wc GROUP BY comp), ranked AS (SELECT comp, n, row_number() OVER (ORDER BY n DESC, comp) - 1 AS component_id FROM sized)"""


@query(f"WITH RECURSIVE {_TIED} SELECT node, comp, component_id, n FROM wc JOIN ranked USING (comp)")
def wcc(s, d):
    """Weakly connected components by size."""
    nodes, edges = _inner(s, d)
    return G.component_ranks(cut(L.component_names(nodes, edges)))


@query()
def kcore(s, d):
    nodes, edges = _inner(s, d)
    return L.cores(nodes, edges)


@query(f"WITH RECURSIVE {_WAYS} SELECT node, scc FROM grp")
def scc(s, d):
    """Strongly connected groups."""
    return L.strong_components(*_inner(s, d)).select("node", "scc")


@query(f"WITH RECURSIVE {_WAYS}, n AS (SELECT scc, count(*) AS n FROM grp GROUP BY scc) SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS bucket, count(*) AS groups FROM n GROUP BY ALL")
def scc_histogram(s, d):
    """Groups by size: 1, 2, 3 to 5, 6 to 20, more."""
    sizes = L.strong_components(*_inner(s, d)).groupBy("scc").agg(F.count("*").alias("n"))
    bucket = ladder((F.col("n") == 1, "1"), (F.col("n") == 2, "2"), (F.col("n") <= 5, "3-5"), (F.col("n") <= 20, "6-20"), otherwise="21+")
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("groups"))


@query(f"WITH RECURSIVE {_WAYS} SELECT rank, count(*) AS groups FROM deep GROUP BY rank")
def dag_depth(s, d):
    """Longest ways in the graph of strongly connected groups: how many groups have each rank."""
    return L.strong_components(*_inner(s, d)).select("scc", "rank").distinct().groupBy("rank").agg(F.count("*").alias("groups"))


@query()
def pagerank(s, d):
    return rounded(G.pagerank(*_inner(s, d)), "rank", digits=9)


@query()
def hits(s, d):
    return rounded(G.hits(*_inner(s, d)), "hub", "authority", digits=9)


@query()
def betweenness(s, d):
    """Betweenness over calls from all sources."""
    return rounded(G.betweenness(*_inner(s, d)), "betweenness", digits=9)


@query()
def betweenness_sampled(s, d):
    """Betweenness from 500 sampled sources beyond 2,000 functions: the sampling is the operator's own."""
    nodes, edges = _inner(s, d)
    return rounded(G.betweenness(nodes, edges, 500 if nodes.count() > 2000 else None), "betweenness", digits=9)


@query()
def component_roles(s, d):
    nodes, edges = _inner(s, d)
    comps = cut(L.component_names(nodes, edges))
    return rounded(G.component_summary(nodes, edges, comps, L.cores(nodes, edges), "size"), "density", "avg_degree")


@query()
def power_law(s, d):
    nodes, edges = call_lists(s, d)
    deg = G.degrees(nodes, edges.filter("dst is not null"), True).groupBy(F.col("n_in").alias("degree")).agg(F.count("*").alias("n"))
    return rounded(G.power_law(deg), "alpha", "log_ratio", digits=4)


@query()
def compound_score(s, d):
    """Own score (sized bodies score more) tempered by the callees' scores."""
    nodes, edges = _inner(s, d)
    scored = nodes.withColumn("own", F.least(F.lit(1.0), F.coalesce("size", F.lit(0)) / 1000.0))
    return rounded(L.compound(scored, edges, "own"), "score")


@query(f"WITH {GRAPH}, i AS (SELECT node, coalesce(n, 0) AS n FROM nodes LEFT JOIN (SELECT dst AS node, count(*) AS n FROM de GROUP BY dst) USING (node)) SELECT count(*) AS n_nodes, round(avg(CAST(n = 0 AS INT)), 6) AS zero_share, avg(CAST(n = 0 AS INT)) < 0.6 AS valid FROM i")
def pagerank_validity(s, d):
    """Whether few enough functions lack callers for ranks to mean something."""
    nodes, edges = call_lists(s, d)
    g = G.degrees(nodes, edges.filter("dst is not null"), True)
    share = F.avg((F.col("n_in") == 0).cast("double"))
    return rounded(g.agg(F.count("*").alias("n_nodes"), share.alias("zero_share"), (share < 0.6).alias("valid")), "zero_share")


@query(f"""WITH {NOW}, seed AS (SELECT label, {HEX.format("t")} AS addr FROM (SELECT label, unnest(function_seeds) AS t FROM program)), n AS (SELECT fn_id, label, {HEX.format("va")} AS addr FROM now) SELECT DISTINCT fn_id FROM n JOIN seed USING (label, addr)""")
def known_seeds(s, d):
    """Declared seeds that are functions."""
    from ..functions.addresses import address

    nodes, _ = call_lists(s, d)
    seeds = table(s, d, "program").select("label", F.explode("function_seeds").alias("t")).select("label", address(F.col("t")).alias("addr")).distinct()
    return nodes.join(seeds, ["label", "addr"], "left_semi").select(F.col("node").alias("fn_id"))
