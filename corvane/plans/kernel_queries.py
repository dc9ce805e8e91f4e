"""Queries over spectra, grammars, clusters, state machines and constants; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, grammar, spectral
from ..operators import incidence as I
from ..operators import patterns as P
from ..sources.relations import global_reads, operations, rounded
from ..sources.tables import current_functions, table
from ..streaming import monitor
from .corpus_queries import NOW
from .io_queries import READS
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


def _cells(s, d):
    return global_reads(s, d).select(F.col("label").alias("matrix"), F.col("fn").alias("row_id"), F.col("addr").alias("col_id")).distinct()


@query()
def gf2_rank(s, d):
    """Rank over GF(2) of each binary's function by global matrix, and its band of redundancy."""
    r = spectral.gf2_rank(_cells(s, d))
    return rounded(r.withColumn("band", spectral.redundancy_band(F.col("redundancy"))), "redundancy")


@query()
def gf2_staircase(s, d):
    return spectral.gf2_staircase(_cells(s, d))


@query()
def jump_density(s, d):
    return rounded(spectral.jump_density(spectral.gf2_staircase(_cells(s, d))), "early", "late", "ratio")


@query(f"WITH {READS} SELECT label AS matrix, count(DISTINCT fn) AS n_rows, count(DISTINCT addr) AS n_cols, count(DISTINCT (fn, addr)) AS n_cells FROM reads GROUP BY label")
def incidence_size(s, d):
    """Rows, columns and entries of each binary's matrix."""
    return _cells(s, d).groupBy("matrix").agg(F.count_distinct("row_id").alias("n_rows"), F.count_distinct("col_id").alias("n_cols"), F.count("*").alias("n_cells"))


@query()
def singular_values(s, d):
    return rounded(spectral.singular_values(_cells(s, d)), "sigma", "gap", "mp_upper", "over", digits=5)


@query()
def leverage(s, d):
    return rounded(spectral.leverage(_cells(s, d)), "leverage", digits=5)


@query()
def brody_beta(s, d):
    """The Brody exponent of each binary's whole spectrum."""
    return rounded(spectral.brody(spectral.spacings(spectral.singular_values(_cells(s, d), None))), "beta", "ks", digits=4)


@query()
def fiedler_value(s, d):
    """Connectedness of each binary's graph of globals that are read together."""
    pairs = I.co_access(global_reads(s, d)).withColumnRenamed("label", "matrix")
    return rounded(spectral.fiedler(pairs), "fiedler", digits=5)


@query()
def svd30(s, d):
    return rounded(spectral.truncated_svd(table(s, d, "embeddings"), 30), "sigma", digits=4)


@query()
def density_clusters(s, d):
    return density.density_clusters(table(s, d, "embeddings"), "vec_id", "embedding", min_size=20, min_samples=5)


@query()
def bootstrap_cv(s, d):
    """How the mean function size settles with the sample: the sampling is the operator's own."""
    items = current_functions(s, d, ["size"]).filter("size is not null").select(F.col("fn_id").alias("id"), F.col("size").cast("double").alias("value"))
    return rounded(spectral.bootstrap(items, "value", [10, 50, 200, 1000]), "mean", "sd", "cv")


@query(f"""WITH {NOW}, v AS (SELECT label, CAST(size AS DOUBLE) AS x FROM now WHERE size IS NOT NULL), h AS (SELECT x, count(*) AS c FROM v GROUP BY x), r AS (SELECT x, coalesce(sum(c) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rank FROM h), g AS (SELECT label, sum(rank) AS r, count(*) AS k FROM v JOIN r USING (x) GROUP BY label)
SELECT sum(k) AS n, count(*) AS groups, round(12 / (sum(k) * (sum(k) + 1)) * sum(r * r / k) - 3 * (sum(k) + 1), 4) AS h FROM g""")
def kruskal_wallis(s, d):
    """Whether function sizes differ between binaries."""
    v = current_functions(s, d, ["label", "size"]).filter("size is not null").select("label", F.col("size").cast("double").alias("x"))
    return rounded(spectral.kruskal_wallis(v, "label", "x"), "h", digits=4)


@query()
def pair_grammar(s, d):
    """Rules from rounds of pair replacement over operations, with what they look like."""
    rules = grammar.kept(grammar.mine(operations(s, d)))
    return rules.select("rule_id", "count", F.array_join("expansion", " ").alias("expansion"), P.rule_label(F.col("expansion")).alias("label"))


def _readings(s, d):
    e = table(s, d, "events")
    return e.select(F.pmod("user_id", F.lit(50)).alias("block"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))


_SEEN = "seen AS (SELECT user_id % 50 AS block, event_id AS seq, event_type AS c, lag(event_type) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS p FROM events), ch AS (SELECT block, seq, row_number() OVER (PARTITION BY block ORDER BY seq) AS n FROM seen WHERE p IS NOT NULL AND c <> p)"


@query(f"WITH {_SEEN} SELECT block, seq, n FROM ch")
def content_changes(s, d):
    """Readings of a block that differ from the one before."""
    return monitor.changes(_readings(s, d))


@query(f"WITH {_SEEN} SELECT block, seq, n, CASE WHEN n <= 3 THEN 'change' ELSE 'summary' END AS event FROM ch WHERE n <= 3 OR n % 20 = 0")
def throttled_changes(s, d):
    return monitor.throttled(monitor.changes(_readings(s, d)))


@query()
def tiered_monitor(s, d):
    """The tiers each block goes through, from a replay of its readings."""
    return monitor.replay(_readings(s, d).select("block", "seq", F.md5("content").alias("digest")))


@query("SELECT user_id % 10 AS session, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 4096 END AS off FROM events WHERE event_type <> 'view' AND md5(event_type) NOT LIKE '0000%' AND user_id % 10 <> 3 AND (event_id % 3 = 0 OR event_id * 4096 > 0)")
def session_log(s, d):
    """Observations within sessions, with plausible offsets."""
    e = table(s, d, "events").select(
        F.when(F.pmod("user_id", F.lit(10)) != 3, F.pmod("user_id", F.lit(10))).alias("session"), F.when(F.col("event_type") != "view", "observation").otherwise("begin").alias("event"), F.col("event_id").alias("seq"),
        F.md5("event_type").alias("block"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 4096).otherwise(F.lit(-1)).alias("offset"),
    )
    kept = monitor.session_log(e).filter("offset != 0")
    return kept.select("session", "seq", F.when(F.col("offset") > 0, F.col("offset")).alias("off"))
