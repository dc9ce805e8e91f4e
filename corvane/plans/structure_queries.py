"""Queries over nested reports, call hierarchies and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import address, address_text
from ..operators import hierarchy as H
from ..operators import nested as N
from ..operators.orphans import dangling_references, orphan_report
from ..sources.tables import call_graph, table
from .lineage import cut

REPORT_FIELDS = ("clusters", "indirect_structs", "n_globals", "n_fns", "T3_global", "T3_z_global", "dominant_type")
REPORT_TABLES = [
    ("cluster", None, "clusters", "list"),
    ("cluster_address", "cluster", "addresses", "list"),
    ("indirect_base", None, "indirect_structs", "keyed", "base", "base_address", "address", "va", "/", "fields", "offsets"),
    ("indirect_field", "indirect_base", "", "keyed", "offset", "off", "field"),
]


#: Names of relations by path, with other spellings of keys and contents, and what makes each of them a table even where a folder holds lone ones only.
REPORT_NAMES = {
    "$.clusters": ("cluster",), "$.clusters.addresses": ("cluster_address",), "$.indirect_structs": ("indirect_base", "base", "base_address", "address", "va", "/", "fields", "offsets"), "$.indirect_structs{}": ("indirect_field", "offset", "off", "field"),
}
REPORT_KINDS = [("$.clusters", "list"), ("$.clusters.addresses", "list"), ("$.indirect_structs", "map"), ("$.indirect_structs{}", "map")]
#: The relations of p1_found.
CHILDREN = ("cluster", "cluster_address", "indirect_base", "indirect_field", "constraint", "constraint_var")


def report_rows(spark: SparkSession, folder: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the reports' tables, which are those that inlining of their schema graph gives."""
    reports = table(spark, folder, "geometry_report").filter("payload is not null")
    best = cut(N.latest_readable(reports, "report_id", "run_ts", "payload", REPORT_FIELDS))
    graph = [(r["path"], r["kind"]) for r in N.schema_graph(best, "payload", REPORT_FIELDS).select("path", "kind").collect()]
    plan = N.shred_plan(N.inlining(graph + REPORT_KINDS), REPORT_NAMES)
    rows = N.shred(best, "report_id", "payload", REPORT_FIELDS, [t for t in plan if not only or t[0] in ("record", *only)])
    return rows.filter(F.col("rel").isin(*only)) if only else rows


def exec_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the executions' constraints and of each list in them, by inlining of their type."""
    runs = table(spark, folder, "exec_result")
    tables = N.inlining(N.type_graph(runs.schema["constraints"].dataType))
    lists = [p[2:] for p, t in tables.items() if t["parent"] == "$" and t["why"] == "repeated" and "." not in p[2:]]
    return N.explode_typed(runs, "exec_id", "constraints", "constraint", {x: {"vars": "constraint_var"}.get(x, f"constraint_{x}") for x in lists})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Children of reports and executions, one row each."""
    rows = report_rows(spark, folder, CHILDREN).unionByName(exec_rows(spark, folder).filter(F.col("rel").isin(*CHILDREN)))
    return rows.select("rel", "parent_id", "k1", "k2").distinct()


def p1_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all flat tables, the record's among them, with their inlined columns; copies of a child keep the greatest."""
    rows = report_rows(spark, folder).unionByName(exec_rows(spark, folder))
    return rows.groupBy("rel", "parent_id", "k1", "k2", "rest").agg(F.max("columns").alias("columns")).select("rel", "parent_id", "k1", "k2", "columns", "rest")


def p1_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The schema graph of the reports: element paths, kinds and counts."""
    return N.schema_graph(table(spark, folder, "geometry_report"), "payload")


def call_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = call_graph(spark, folder)
    return H.hierarchy(cut(nodes), edges)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each function with its roots."""
    rows = call_hierarchy(spark, folder)
    return rows.select(F.col("grp").alias("label"), address_text(F.col("node")).alias("va"), address_text(F.col("root")).alias("root_va"), "depth", "on_cycle")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each function and root with the path between them and the number of descendants below."""
    rows = H.paths(cut(call_hierarchy(spark, folder)))
    path = F.array_join(F.transform("path", address_text), " > ")
    return rows.select(F.col("grp").alias("label"), address_text(F.col("node")).alias("va"), address_text(F.col("root")).alias("root_va"), "depth", path.alias("path"), "pre", (F.col("last") - F.col("pre")).alias("n_descendants"))


def reference_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tree = table(spark, folder, "calltree")
    calls = tree.select("label", address_text(address(F.col("va"))).alias("ref_key"), F.to_date("dump_ts").alias("period"), F.explode(F.array_distinct("called_vas")).alias("t"))
    calls = calls.select(F.lit("calltree").alias("ref_table"), "label", "ref_key", address(F.col("t")).alias("target"), "period")
    runs = table(spark, folder, "exec_result")
    runs = runs.select(F.lit("exec_result").alias("ref_table"), "label", F.col("exec_id").cast("string").alias("ref_key"), address(F.col("va")).alias("target"), F.to_date("run_ts").alias("period"))
    parents = tree.select("label", address(F.col("va")).alias("target"), F.to_date("dump_ts").alias("day"))
    gone = table(spark, folder, "retired_function").select("label", address(F.col("va")).alias("target"), F.to_date("retired_ts").alias("day"))
    return calls.unionByName(runs), parents, gone


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """References whose function is missing, deleted or late."""
    found = dangling_references(*reference_tables(spark, folder), on=["label", "target"])
    return found.select("ref_table", "label", "ref_key", address_text(F.col("target")).alias("target_va"), F.date_format("period", "yyyy-MM-dd").alias("period"), "state")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of dangling references by table, day and state."""
    return orphan_report(p4_found(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p1_schema": p1_schema, "p2_found": p2_found, "p2_paths": p2_paths, "p4_found": p4_found, "p4_report": p4_report}

_NUMBER = r"TRY_CAST('0x' || regexp_extract({0}, '^\s*(?:0[xX])?0*([0-9a-fA-F]{{1,15}})\s*$', 1) AS BIGINT)"
_NOW = "now AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY fn_id ORDER BY dump_ts DESC) AS rn FROM calltree) WHERE rn = 1)"
# all ways between functions, and from them the groups, roots and depths
_TREES = f"""{_NOW}, nodes AS (SELECT label, fn_id AS id, {_NUMBER.format("va")} AS k FROM now WHERE label IS NOT NULL AND {_NUMBER.format("va")} IS NOT NULL),
calls AS (SELECT DISTINCT label, fn_id AS src, {_NUMBER.format("t")} AS v FROM (SELECT label, fn_id, va, unnest(called_vas) AS t FROM now) WHERE {_NUMBER.format("va")} IS NOT NULL),
e AS (SELECT DISTINCT c.src, n.id AS dst FROM calls c JOIN nodes n ON n.label = c.label AND n.k = c.v),
way(a, b) AS (SELECT src, dst FROM e UNION SELECT way.a, e.dst FROM way JOIN e ON e.src = way.b),
member AS (SELECT n.label, n.id, n.k, coalesce(min(m.k), n.k) AS head FROM nodes n LEFT JOIN (SELECT x.a, x.b FROM way x JOIN way y ON x.a = y.b AND x.b = y.a) g ON g.a = n.id LEFT JOIN nodes m ON m.id = g.b GROUP BY n.label, n.id, n.k),
head AS (SELECT label, id, k, least(head, k) AS head FROM member),
called AS (SELECT DISTINCT y.label, y.head FROM e JOIN head x ON x.id = e.src JOIN head y ON y.id = e.dst WHERE x.head <> y.head),
root AS (SELECT h.label, h.id, h.k FROM head h WHERE h.k = h.head AND NOT EXISTS (SELECT 1 FROM called c WHERE c.label = h.label AND c.head = h.head)),
down(root, id, d) AS (SELECT id, id, 0 FROM root UNION SELECT down.root, e.dst, d + 1 FROM down JOIN e ON e.src = down.id WHERE d < 150),
depth AS (SELECT root, id, min(d) AS d FROM down GROUP BY ALL)"""
_LOOSE = f"""refs AS (SELECT DISTINCT 'calltree' AS ref_table, label, printf('0x%x', k) AS ref_key, {_NUMBER.format("t")} AS target, period FROM (SELECT label, {_NUMBER.format("va")} AS k, CAST(dump_ts AS DATE) AS period, unnest(called_vas) AS t FROM calltree)
UNION SELECT 'exec_result', label, CAST(exec_id AS VARCHAR), {_NUMBER.format("va")}, CAST(run_ts AS DATE) FROM exec_result),
first AS (SELECT label, {_NUMBER.format("va")} AS target, min(CAST(dump_ts AS DATE)) AS day FROM calltree GROUP BY ALL), gone AS (SELECT label, {_NUMBER.format("va")} AS target, min(CAST(retired_ts AS DATE)) AS day FROM retired_function GROUP BY ALL),
state AS (SELECT r.*, CASE WHEN g.day <= r.period THEN 'deleted' WHEN f.target IS NULL THEN 'missing' WHEN f.day > r.period THEN 'late' END AS state FROM refs r LEFT JOIN first f USING (label, target) LEFT JOIN gone g USING (label, target) WHERE r.target IS NOT NULL AND r.label IS NOT NULL),
loose AS (SELECT ref_table, label, ref_key, printf('0x%x', target) AS target_va, strftime(period, '%Y-%m-%d') AS period, state FROM state WHERE state IS NOT NULL)"""

SQL = {
    "p2_found": f"WITH RECURSIVE {_TREES} SELECT n.label, printf('0x%x', n.k) AS va, printf('0x%x', r.k) AS root_va, d AS depth, CAST(EXISTS (SELECT 1 FROM way WHERE way.a = n.id AND way.b = n.id) AS INT) AS on_cycle FROM depth JOIN nodes n USING (id) JOIN root r ON r.id = depth.root",
    "p4_found": f"WITH {_LOOSE} SELECT * FROM loose",
    "p4_report": f"WITH {_LOOSE} SELECT ref_table, period, state, count(*) AS n_references, count(DISTINCT (label, target_va)) AS n_targets, count(DISTINCT (label, ref_key)) AS n_keys FROM loose GROUP BY ALL",
}
