"""Queries over token corpora, patterns and text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import corpus as C
from ..operators import patterns as P
from ..operators import textfeat as X
from ..sources.relations import corpus, operations, rounded
from ..sources.tables import current_functions, table
from .lineage import cut

NOW = "now AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY fn_id ORDER BY dump_ts DESC) AS rn FROM calltree) WHERE rn = 1)"
CORPUS = NOW + ", corpus AS (SELECT label, fn_id, regexp_extract_all(lower(pseudocode), '[a-z]+') AS tokens FROM now WHERE pseudocode IS NOT NULL), tok AS (SELECT label, fn_id, unnest(tokens) AS token FROM corpus)"
_RAW = "['COPY','INT_SUB','STORE','LOAD','INT_ADD','RETURN','FLOAT_ADD','INT_CARRY','BOOL_AND','MULTIEQUAL','CBRANCH','CALL','INT_LESS','INT_EQUAL','POPCOUNT','INT_REM']"
OPS = f"""raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_RAW}[(l_partkey % 16) + 1] AS name, [8, 8, 1][(l_suppkey % 3) + 1] AS size FROM lineitem),
named AS (SELECT *, CASE name WHEN 'FLOAT_ADD' THEN 'FLOAT_ARITH' WHEN 'INT_CARRY' THEN 'OVERFLOW_CHECK' WHEN 'BOOL_AND' THEN 'BOOL_OP' WHEN 'INT_LESS' THEN 'INT_UCMP' WHEN 'INT_REM' THEN 'INT_MODULO' ELSE name END AS base FROM raw
  WHERE name <> 'MULTIEQUAL' AND NOT (name = 'POPCOUNT' AND size = 1)),
line AS (SELECT *, CASE WHEN base IN ('CBRANCH','CALL','RETURN') THEN base ELSE base || '_' || size END AS token FROM named),
corpus AS (SELECT o_orderpriority AS label, l_orderkey AS fn_id, list(token ORDER BY l_linenumber, l_partkey, l_suppkey, token) AS tokens FROM line JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"""
# the rule miner over operations: pairs of neighbouring tokens
RULES = """runs AS (SELECT tokens[i] || ' ' || tokens[i + 1] AS e FROM corpus, unnest(range(1, len(tokens))) AS t(i)),
rules AS (SELECT row_number() OVER (ORDER BY n DESC, e) - 1 AS rule_id, n AS "count", e FROM (SELECT e, count(*) AS n FROM runs GROUP BY e ORDER BY n DESC, e LIMIT 300)),
present AS (SELECT label, fn_id, rule_id FROM corpus, rules WHERE list_has_all(tokens, string_split(e, ' ')))"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {CORPUS}, n AS (SELECT label, token, count(*) AS c FROM tok GROUP BY ALL), t AS (SELECT *, c / sum(c) OVER (PARTITION BY label) AS p FROM n) SELECT label, count(*) AS n_unique, sum(c) AS n_total, round(sum(-p * log2(p)), 6) AS entropy FROM t GROUP BY label")
def token_entropy(s, d):
    """Distinct and all tokens, and entropy, of each binary's bodies."""
    return rounded(C.diversity(corpus(s, d)), "entropy")


@query(f"WITH {CORPUS}, n AS (SELECT token, count(*) AS n FROM tok GROUP BY token) SELECT row_number() OVER (ORDER BY token) - 1 AS idx, token, n FROM n")
def vocab_counts(s, d):
    return C.vocabulary(corpus(s, d))


@query(f"WITH {CORPUS}, n AS (SELECT fn_id, token, count(*) AS tf FROM tok GROUP BY ALL) SELECT fn_id, token, tf, round(tf / sum(tf) OVER (PARTITION BY fn_id), 6) AS l1 FROM n")
def tf_l1(s, d):
    return rounded(C.term_frequency(corpus(s, d)), "l1")


@query(f"WITH {NOW} SELECT label, count(*) AS n_functions FROM now GROUP BY label")
def functions_per_label(s, d):
    return current_functions(s, d, ["label"]).groupBy("label").agg(F.count("*").alias("n_functions"))


@query(f"WITH {OPS} SELECT label, fn_id, array_to_string(tokens, ' ') AS tokens FROM corpus")
def opcode_tokens(s, d):
    """Raw operations as tokens: dropped, merged and sized."""
    return operations(s, d).select("label", "fn_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {OPS}, j AS (SELECT fn_id, array_to_string(list_filter(tokens, lambda x: x <> 'OVERFLOW_CHECK_1'), ' ') AS t FROM corpus)
SELECT fn_id, trim(regexp_replace(regexp_replace(t, '^(COPY_8 )*INT_SUB_8 STORE_[^ ]+( |$)', '__PROLOGUE__ '), '(^| )LOAD_8 INT_ADD_8 RETURN$', ' __EPILOGUE__')) AS tokens FROM j""")
def normalize_tokens(s, d):
    """Frame set-up and tear-down rewritten."""
    return operations(s, d).select("fn_id", F.array_join(C.rewritten(F.col("tokens")), " ").alias("tokens"))


@query(f"WITH {OPS} SELECT label, sum(len(list_filter(tokens, lambda x: x = 'OVERFLOW_CHECK_1'))) AS removed, sum(len(tokens)) AS n_tokens FROM corpus GROUP BY label")
def removed_overflow(s, d):
    return C.removed_overflow(operations(s, d))


@query(f"WITH {CORPUS} SELECT corpus.fn_id, size, len(tokens) AS n_tokens FROM corpus JOIN now USING (fn_id) WHERE size BETWEEN 4 AND 8000 AND len(tokens) > 0")
def size_guard(s, d):
    sized = corpus(s, d).join(current_functions(s, d, ["size"]), "fn_id")
    return C.size_guard(sized).select("fn_id", "size", F.size("tokens").alias("n_tokens"))


def _mined(s, d):
    ops = cut(operations(s, d))
    return ops, cut(P.frequent_runs(ops))


@query(f'WITH {OPS}, {RULES} SELECT rule_id, "count", e AS expansion FROM rules')
def rule_miner(s, d):
    """The grammar: most frequent pairs of operations."""
    _, rules = _mined(s, d)
    return rules.select("rule_id", "count", F.array_join("expansion", " ").alias("expansion"))


@query(f"WITH {OPS}, {RULES} SELECT label, fn_id, rule_id FROM present")
def rule_presence(s, d):
    ops, rules = _mined(s, d)
    return P.presence(ops, rules)


@query(f"WITH {OPS}, {RULES} SELECT rule_id, label, count(*) AS n FROM present GROUP BY ALL")
def rule_usage(s, d):
    ops, rules = _mined(s, d)
    return P.presence(ops, rules).groupBy("rule_id", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {OPS}, {RULES}, k AS (SELECT rule_id, count(fn_id) / (SELECT count(*) FROM corpus) AS p FROM rules LEFT JOIN present USING (rule_id) GROUP BY rule_id)
SELECT rule_id, round(p, 6) AS p, round(p * (1 - p) / max(p * (1 - p)) OVER (), 6) AS weight FROM k""")
def rule_variance(s, d):
    ops, rules = _mined(s, d)
    return rounded(P.rule_weights(P.presence(ops, rules), rules, ops), "p", "weight")


@query(f"WITH {OPS}, {RULES} SELECT label, corpus.fn_id, round(count(rule_id) / greatest((SELECT count(*) FROM rules), 1), 6) AS coverage FROM corpus LEFT JOIN present USING (label, fn_id) GROUP BY ALL")
def coverage(s, d):
    ops, rules = _mined(s, d)
    return rounded(P.coverage(P.presence(ops, rules), ops, rules), "coverage")


_COVER = f"{OPS}, {RULES}, cover AS (SELECT label, corpus.fn_id, count(rule_id) / greatest((SELECT count(*) FROM rules), 1) AS coverage FROM corpus LEFT JOIN present USING (label, fn_id) GROUP BY ALL)"


@query(f"WITH {_COVER} SELECT label, round(avg(coverage), 6) AS mean, round(stddev_pop(coverage), 6) AS sd, round(quantile_cont(coverage, 0.5), 6) AS median, CASE WHEN avg(coverage) < 0.2 THEN 'low' WHEN avg(coverage) < 0.35 THEN 'moderate' WHEN avg(coverage) < 0.5 THEN 'good' ELSE 'high' END AS verdict FROM cover GROUP BY label")
def coverage_stats(s, d):
    ops, rules = _mined(s, d)
    c = P.coverage(P.presence(ops, rules), ops, rules)
    out = c.groupBy("label").agg(F.avg("coverage").alias("mean"), F.stddev_pop("coverage").alias("sd"), F.percentile("coverage", 0.5).alias("median"))
    return rounded(out.withColumn("verdict", P.coverage_verdict(F.col("mean"))), "mean", "sd", "median")


@query(f"""WITH {_COVER}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coverage, fn_id) AS lo, row_number() OVER (PARTITION BY label ORDER BY coverage DESC, fn_id) AS hi FROM cover)
SELECT label, fn_id, round(coverage, 6) AS coverage, lo, hi FROM r WHERE lo <= 10 OR hi <= 10""")
def coverage_extremes(s, d):
    """The ten functions of least and of most coverage of each label."""
    ops, rules = _mined(s, d)
    c = P.coverage(P.presence(ops, rules), ops, rules)
    lo, hi = Window.partitionBy("label").orderBy("coverage", "fn_id"), Window.partitionBy("label").orderBy(F.desc("coverage"), "fn_id")
    return rounded(c.withColumn("lo", F.row_number().over(lo)).withColumn("hi", F.row_number().over(hi)).filter("lo <= 10 or hi <= 10"), "coverage")


_LIFT = f"""{OPS}, {RULES}, size AS (SELECT label, count(*) AS n FROM corpus GROUP BY label), overall AS (SELECT rule_id, count(*) / (SELECT count(*) FROM corpus) AS overall FROM present GROUP BY rule_id),
lift AS (SELECT label, rule_id, count(*) / any_value(n) AS local, any_value(overall) AS overall, count(*) / any_value(n) - any_value(overall) AS lift FROM present JOIN size USING (label) JOIN overall USING (rule_id) GROUP BY ALL)"""


@query(f"WITH {_LIFT} SELECT label, rule_id, round(local, 6) AS local, round(overall, 6) AS overall, round(lift, 6) AS lift FROM lift")
def rule_lift(s, d):
    ops, rules = _mined(s, d)
    return rounded(P.lift(P.presence(ops, rules), ops, "label"), "local", "overall", "lift")


@query(f"WITH {_LIFT}, r AS (SELECT label, rule_id, round(lift, 6) AS lift, row_number() OVER (PARTITION BY label ORDER BY round(lift, 6) DESC, rule_id) AS rank FROM lift) SELECT * FROM r WHERE rank <= 6")
def rule_lift_top(s, d):
    """The six rules that stand out most in each label."""
    ops, rules = _mined(s, d)
    lift = rounded(P.lift(P.presence(ops, rules), ops, "label"), "lift").select("label", "rule_id", "lift")
    return P.top_per_group(lift, ["label"], [F.desc("lift"), F.col("rule_id")], 6)


@query(f"""WITH {OPS}, {RULES}, size AS (SELECT label, count(*) AS n FROM corpus GROUP BY label), v AS (SELECT label, rule_id, count(*) / any_value(n) AS x FROM present JOIN size USING (label) GROUP BY ALL), nn AS (SELECT label, sqrt(sum(x * x)) AS norm FROM v GROUP BY label)
SELECT p.label AS a, q.label AS b, round(sum(p.x * q.x) / any_value(np.norm * nq.norm), 6) AS cosine FROM v p JOIN v q USING (rule_id) JOIN nn np ON np.label = p.label JOIN nn nq ON nq.label = q.label WHERE p.label < q.label GROUP BY ALL""")
def profile_cosine(s, d):
    ops, rules = _mined(s, d)
    return rounded(P.profile_cosine(P.presence(ops, rules), ops), "cosine")


_ARCH = f"{OPS}, arch AS (SELECT label, fn_id, lower(array_to_string(tokens, ' ')) AS t FROM corpus), typed AS (SELECT label, fn_id, CASE WHEN contains(t, 'load_8 int_add_8 return') OR contains(t, 'load_8 copy_8 int_add_8 return') THEN 'GETTER' WHEN contains(t, 'branchind') THEN 'DISPATCHER' WHEN contains(t, 'float_arith') OR contains(t, 'float_cast') THEN 'FLOAT_COMPUTE' WHEN contains(t, 'bool_op_1 cbranch') THEN 'GUARD_COMPOUND' WHEN contains(t, 'int_equal_1') AND contains(t, 'cbranch') THEN 'GUARD_SIMPLE' WHEN contains(t, 'store_16') OR contains(t, 'load_16') THEN 'SIMD_COPY' WHEN contains(t, 'int_add_8 copy_8 store_8') AND NOT contains(t, 'load') THEN 'WRITER' WHEN contains(t, 'int_add_8 load_8 copy_8') THEN 'READER' WHEN contains(t, 'copy_8 copy_8 copy_8') THEN 'REGISTER_HEAVY' WHEN contains(t, 'overflow_check') OR contains(t, 'int_ucmp') THEN 'ARITHMETIC' ELSE 'MIXED' END AS archetype FROM arch)"


def _typed(s, d):
    return operations(s, d).select("label", "fn_id", P.archetype(F.array_join("tokens", " ")).alias("archetype"))


@query(f"WITH {_ARCH}, n AS (SELECT archetype, count(*) AS n FROM typed GROUP BY archetype) SELECT archetype, n, round(100 * n / sum(n) OVER (), 6) AS pct FROM n")
def archetype_dist(s, d):
    n = _typed(s, d).groupBy("archetype").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return rounded(n.join(F.broadcast(total)).select("archetype", "n", (100 * F.col("n") / F.col("t")).alias("pct")), "pct")


@query(f"WITH {_ARCH}, n AS (SELECT label, archetype, count(*) AS n FROM typed GROUP BY ALL) SELECT label, archetype, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM n")
def archetype_matrix(s, d):
    return rounded(P.share_matrix(_typed(s, d), "archetype", "label"), "share")


@query(f"""WITH {_ARCH}, f AS (SELECT label, avg(CAST(archetype = 'ARITHMETIC' AS INT)) AS a, avg(CAST(archetype LIKE 'GUARD%' AS INT)) AS g, avg(CAST(archetype = 'GETTER' AS INT)) AS t, avg(CAST(archetype = 'CALLER' AS INT)) AS c, avg(CAST(archetype = 'WRITER' AS INT)) AS w, avg(CAST(archetype = 'MIXED' AS INT)) AS m FROM typed GROUP BY label)
SELECT label, CASE WHEN a > 0.2 THEN 'Arithmetic-heavy' WHEN g > 0.3 THEN 'Validation-heavy' WHEN t > 0.25 THEN 'Accessor-heavy' WHEN c > 0.35 THEN 'Orchestration-heavy' WHEN w > 0.25 THEN 'State-writing' WHEN m > 0.25 THEN 'Mixed' END AS fingerprint FROM f""")
def domain_fingerprint(s, d):
    share = lambda c: F.avg(c.cast("double"))
    a = F.col("archetype")
    f = _typed(s, d).groupBy("label").agg(share(a == "ARITHMETIC").alias("a"), share(a.startswith("GUARD")).alias("g"), share(a == "GETTER").alias("t"), share(a == "CALLER").alias("c"), share(a == "WRITER").alias("w"), share(a == "MIXED").alias("m"))
    return f.select("label", P.domain_fingerprint(F.lit(0.0), *[F.col(x) for x in "agtcwm"]).alias("fingerprint"))


@query(f"""WITH {_COVER}, j AS (SELECT label, fn_id, coverage, len(tokens) AS size FROM cover JOIN corpus USING (label, fn_id) WHERE coverage <= 0.15),
r AS (SELECT label, fn_id, round(coverage, 6) AS coverage, size, row_number() OVER (PARTITION BY label ORDER BY coverage, size, fn_id) AS rank, count(*) OVER (PARTITION BY label) AS n_all FROM j) SELECT * FROM r WHERE rank <= 20""")
def novel_topk(s, d):
    """Functions that the grammar covers least, twenty of each label, with how many there are."""
    ops, rules = _mined(s, d)
    c = P.coverage(P.presence(ops, rules), ops, rules).filter("coverage <= 0.15").join(ops.select("fn_id", F.size("tokens").alias("size")), "fn_id")
    n = c.groupBy("label").agg(F.count("*").alias("n_all"))
    top = P.top_per_group(c, ["label"], [F.col("coverage"), F.col("size"), F.col("fn_id")], 20)
    return rounded(top.join(F.broadcast(n), "label").select("label", "fn_id", "coverage", "size", "rank", "n_all"), "coverage")


@query(f"WITH {_COVER}, r AS (SELECT label, fn_id, round(coverage, 6) AS coverage, row_number() OVER (PARTITION BY label ORDER BY coverage DESC, fn_id) AS rank FROM cover WHERE coverage >= 0.2) SELECT * FROM r WHERE rank <= 10")
def predictable_topk(s, d):
    ops, rules = _mined(s, d)
    c = P.coverage(P.presence(ops, rules), ops, rules).filter("coverage >= 0.2")
    return rounded(P.top_per_group(c, ["label"], [F.desc("coverage"), F.col("fn_id")], 10), "coverage").select("label", "fn_id", "coverage", "rank")


@query(f"""WITH {OPS}, {RULES} SELECT rule_id, CASE WHEN contains(e, 'OVERFLOW_CHECK') AND contains(e, 'INT_SCMP') AND contains(e, 'INT_EQUAL') THEN 'flag-update block' WHEN contains(e, 'INT_AND_1') AND contains(e, 'INT_SCMP_1') THEN 'flag artifact' WHEN regexp_matches(e, 'INT_ADD_8.*(STORE_8|STORE_4)') THEN 'field WRITE' WHEN regexp_matches(e, 'INT_ADD_8.*LOAD_(8|4)') THEN 'field READ' WHEN regexp_matches(e, 'LOAD_8.*INT_EQUAL_1.*CBRANCH') THEN 'null pointer guard' WHEN regexp_matches(e, 'COPY_8.*INT_EQUAL_1.*CBRANCH') THEN 'value null-check' WHEN contains(e, 'FLOAT_ARITH') THEN 'float computation' WHEN contains(e, 'FLOAT_CAST') THEN 'conversion' WHEN contains(e, 'BRANCHIND') THEN 'dispatch' WHEN e LIKE 'COPY% COPY%' THEN 'register shuffling' ELSE '' END AS label FROM rules""")
def rule_labels(s, d):
    _, rules = _mined(s, d)
    return rules.select("rule_id", P.rule_label(F.col("expansion")).alias("label"))


# ---- text

_T = "coalesce(pseudocode, '')"
_N = lambda p: f"len(regexp_extract_all({_T}, '{p}'))"


@query(f"""WITH {NOW} SELECT fn_id, {_N("while [(]|for [(]|do [{]")} AS loops, {_N("if [(]")} AS branches, {_N("switch [(]")} AS switches, {_N("0x[0-9a-fA-F]+")} AS constants, regexp_matches({_T}, 'float|double') AS has_float, contains({_T}, 'goto ') AS has_goto, {_N("if [(]")} + {_N("switch [(]")} + 1 AS cyclomatic FROM now""")
def keyword_counts(s, d):
    now = current_functions(s, d, ["pseudocode"])
    return now.select("fn_id", *[c.alias(n) for n, c in X.keyword_counts(F.col("pseudocode")).items()])


_RATIO = f"""rc AS (SELECT fn_id, size, pseudocode, {_N("0x[0-9a-fA-F]{4,}|>>|<<|\\^|\\*\\s*0x|\\*\\s*[0-9]{4,}")} AS ar, {_N("\\b(?:while|for)\\b")} AS lo, {_N("\\bif\\b")} AS i, {_N("\\breturn\\b")} AS re, {_N("\\*\\s*\\(|\\*[a-zA-Z_]|->")} AS de, {_N("\\b[A-Za-z_]\\w+\\s*\\(")} AS ca,
{_N("=\\s*[A-Z][A-Za-z0-9_]{3,}")} - {_N("=\\s*[A-Z][A-Za-z0-9_]{3}\\s*\\(")} AS fp FROM now),
ratio AS (SELECT *, greatest(ar + ca + de + lo + i + re, 1) AS t, greatest(coalesce(size, 0), 1) AS sz, coalesce(length(pseudocode) >= 10, false) AS ok FROM rc)"""


@query(f"""WITH {NOW}, {_RATIO} SELECT fn_id, CASE WHEN ok THEN round(ar / t, 3) ELSE 0 END AS arith_ratio, CASE WHEN ok THEN round(ca / t, 3) ELSE 0 END AS call_ratio, CASE WHEN ok THEN round(de / t, 3) ELSE 0 END AS deref_ratio,
CASE WHEN ok THEN round(i / sz, 4) ELSE 0 END AS if_density, CASE WHEN ok THEN round(re / sz, 4) ELSE 0 END AS return_density, CASE WHEN ok THEN round(fp / sz, 4) ELSE 0 END AS fptr_density, CASE WHEN ok THEN lo ELSE 0 END AS loop_count_text FROM ratio""")
def text_ratios(s, d):
    now = current_functions(s, d, ["pseudocode", "size"])
    return now.select("fn_id", *[c.alias(n) for n, c in X.ratios(F.col("pseudocode"), F.col("size")).items()])


_CONST = f"""hx AS (SELECT fn_id, h FROM (SELECT fn_id, unnest(regexp_extract_all({_T}, '0x([0-9a-fA-F]+)', 1)) AS h FROM now WHERE length(pseudocode) >= 20) WHERE length(h) <= 15),
dc AS (SELECT fn_id, regexp_extract(w, '^([1-9][0-9]{{3,17}})(\\.|$)', 1) AS h FROM (SELECT fn_id, unnest(regexp_extract_all({_T}, '[0-9A-Za-z_.]+')) AS w FROM now WHERE length(pseudocode) >= 20)),
cv AS (SELECT fn_id, CAST('0x' || h AS BIGINT) AS v FROM hx UNION ALL SELECT fn_id, CAST(h AS BIGINT) FROM dc WHERE h <> ''), kept AS (SELECT fn_id, v, count(*) AS c FROM cv WHERE v NOT IN (0, 1, 2, 3, 4, 8, 15, 255, 65535, 4294967295) GROUP BY ALL),
tot AS (SELECT fn_id, sum(c) AS t FROM kept GROUP BY fn_id), low AS (SELECT fn_id, sum(c) AS n, sum(c * CAST(v AS DOUBLE)) / sum(c) AS m, sum(c * CAST(v AS DOUBLE) * v) / sum(c) AS m2 FROM kept WHERE v < 16384 GROUP BY fn_id),
prof AS (SELECT fn_id, sum(c) AS n, count(*) AS n_unique, coalesce(sum(c) FILTER (v < 8192), 0) AS small, coalesce(sum(c) FILTER (v >= 8192 AND v < 65536), 0) AS medium, coalesce(sum(c) FILTER (v >= 65536 AND v < 67108864), 0) AS large, coalesce(sum(c) FILTER (v >= 67108864), 0) AS hw, sum(-(c / t) * log2(c / t)) AS entropy FROM kept JOIN tot USING (fn_id) GROUP BY fn_id)"""


@query(f"WITH {NOW}, {_CONST} SELECT now.fn_id, coalesce(prof.n, 0) AS n, coalesce(n_unique, 0) AS n_unique, coalesce(small, 0) AS small, coalesce(medium, 0) AS medium, coalesce(large, 0) AS large, coalesce(hw, 0) AS hw, round(coalesce(entropy, 0), 6) AS entropy, round(CASE WHEN low.n >= 3 THEN 1 / (1 + sqrt(greatest(m2 - m * m, 0)) / m) ELSE 0 END, 6) AS struct_cluster FROM now LEFT JOIN prof USING (fn_id) LEFT JOIN low USING (fn_id)")
def const_profile(s, d):
    """Constants of each body by range, with entropy and closeness of the small ones."""
    now = current_functions(s, d, ["pseudocode"])
    return rounded(X.constant_profile(now, "fn_id", "pseudocode"), "entropy", "struct_cluster")


@query(f"WITH {NOW} SELECT CASE WHEN size < 10 THEN 'TINY' WHEN size < 50 THEN 'SMALL' WHEN size < 200 THEN 'MEDIUM' WHEN size < 1000 THEN 'LARGE' ELSE 'MONOLITH' END AS size_class, count(*) AS n FROM now GROUP BY ALL")
def size_classes(s, d):
    return current_functions(s, d, ["size"]).groupBy(X.size_class(F.col("size")).alias("size_class")).agg(F.count("*").alias("n"))


@query(f"""WITH {NOW}, {_RATIO}, lit AS (SELECT fn_id, lower(unnest(regexp_extract_all({_T}, '"([^"]{{4,}})"', 1))) AS s FROM now), cls AS (SELECT fn_id, CASE WHEN contains(s, 'not implemented') OR contains(s, 'unimplemented') OR contains(s, ' todo ') OR contains(s, 'fixme') THEN 5 WHEN contains(s, 'stub') THEN 3 WHEN contains(s, 'read-only') OR contains(s, 'read only') OR contains(s, 'write to read') OR contains(s, 'write to unused') OR contains(s, 'write to bios') OR contains(s, 'reserved') THEN 4 WHEN contains(s, 'deprecated') OR contains(s, 'assert') THEN 1 WHEN contains(s, 'invalid') OR contains(s, 'illegal') OR contains(s, 'out of range') OR contains(s, 'overflow') THEN 2 END AS p FROM lit WHERE regexp_matches(s, '[a-z] [a-z]'))
SELECT p AS priority, count(*) AS n FROM (SELECT fn_id, max(p) AS p FROM cls GROUP BY fn_id) WHERE p > 1 GROUP BY p""")
def string_classes(s, d):
    """How many bodies have literals of each class that says more than an assertion."""
    now = current_functions(s, d, ["pseudocode"])
    priority = {c: p for _, c, p in X.STRING_CLASSES}
    of = F.create_map(*[x for c, p in priority.items() for x in (F.lit(c), F.lit(p))])
    found = now.select(of[X.string_class(F.col("pseudocode"))].alias("priority")).filter("priority > 1")
    return found.groupBy("priority").agg(F.count("*").alias("n"))


@query()
def dominant_class(s, d):
    """The class of each body by the ladder over ratios, literals and constants."""
    now = current_functions(s, d, ["pseudocode", "size"])
    profile = X.constant_profile(now, "fn_id", "pseudocode")
    r = X.ratios(F.col("pseudocode"), F.col("size"))
    flat = now.join(profile, "fn_id").select("fn_id", "pseudocode", "hw", "small", "struct_cluster", X.string_class(F.col("pseudocode")).alias("fmt"), *[c.alias(n) for n, c in r.items()])
    text = F.col("pseudocode")
    nt = X.count_of(text, r"0x[Cc][0-9a-fA-F]{7}\b") / F.greatest(X.count_of(text, "0x[0-9a-fA-F]+"), F.lit(1))
    cls = X.dominant_class(text, F.col("fmt"), {n: F.col(n) for n in r}, F.col("hw"), F.col("small"), F.col("struct_cluster"), nt, F.lit(False))
    return flat.select("fn_id", cls.alias("dominant_class"))


@query(f"WITH {NOW} SELECT fn_id, CASE WHEN regexp_matches(pseudocode, 'DAT_[0-9a-fA-F]+ =') THEN 'IMPURE' WHEN regexp_matches(pseudocode, 'DAT_[0-9a-fA-F]+') THEN 'PURE_READS' ELSE 'PURE' END AS purity FROM now")
def purity(s, d):
    return current_functions(s, d, ["pseudocode"]).select("fn_id", X.purity(F.col("pseudocode")).alias("purity"))


@query(f"WITH {NOW} SELECT label, count(*) AS n FROM now WHERE regexp_matches(pseudocode, 'DAT_[0-9a-fA-F]+') GROUP BY label")
def global_marker(s, d):
    return current_functions(s, d, ["label", "pseudocode"]).filter(F.col("pseudocode").rlike("DAT_[0-9a-fA-F]+")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {NOW} SELECT fn_id FROM now WHERE coalesce(list_bool_or(list_transform(named_callees, lambda x: contains(x, 'guard_dispatch_icall'))), false) OR contains({_T}, '(**(code') OR contains({_T}, '(*(code **)')")
def vtable_users(s, d):
    return current_functions(s, d, ["pseudocode", "named_callees"]).filter(X.uses_vtable(F.col("pseudocode"), F.col("named_callees"))).select("fn_id")


@query(f"WITH {NOW} SELECT fn_id FROM now WHERE CAST(coalesce(size < 48, false) AS INT) + CAST(coalesce(regexp_matches(name, '{X.UTILITY_NAME}') AND NOT starts_with(name, 'FUN_'), false) AS INT) >= 2")
def utility_suspects(s, d):
    now = current_functions(s, d, ["size", "name"])
    return now.filter(X.utility_suspect(F.lit("MIXED"), F.col("size"), F.col("name"))).select("fn_id")


CATEGORIES = {"memory": ["heap", "page", "stack"], "network": ["packet", "socket", "peer"], "crypto": ["cipher", "digest", "nonce"], "storage": ["journal", "index", "row"]}


@query("""WITH h AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), k AS (SELECT doc_id, CAST(contains(t,'heap') AS INT) + CAST(contains(t,'page') AS INT) + CAST(contains(t,'stack') AS INT) AS m, CAST(contains(t,'packet') AS INT) + CAST(contains(t,'socket') AS INT) + CAST(contains(t,'peer') AS INT) AS n, CAST(contains(t,'cipher') AS INT) + CAST(contains(t,'digest') AS INT) + CAST(contains(t,'nonce') AS INT) AS c, CAST(contains(t,'journal') AS INT) + CAST(contains(t,'index') AS INT) + CAST(contains(t,'row') AS INT) AS s FROM h)
SELECT doc_id, CASE WHEN greatest(m, n, c, s) = 0 THEN 'OTHER' WHEN m = greatest(m, n, c, s) THEN 'memory' WHEN n = greatest(m, n, c, s) THEN 'network' WHEN c = greatest(m, n, c, s) THEN 'crypto' ELSE 'storage' END AS category FROM k""")
def keyword_category(s, d):
    return table(s, d, "documents").select("doc_id", X.keyword_category(F.col("text"), CATEGORIES).alias("category"))


@query()
def boundary_probes(s, d):
    """Values worth trying on each function, from its literals and comparisons."""
    return X.boundary_probes(current_functions(s, d, ["pseudocode"]), "fn_id", "pseudocode")


@query(f"WITH {NOW} SELECT fn_id, CAST(regexp_matches({_T}, '_mm\\d*_|__m128|__m256') AS INT) + CAST(regexp_matches({_T}, '\\bundefined16\\b|\\bxmm\\d') AS INT) + CAST(regexp_matches({_T}, 'CONCAT(88|412|124)') AS INT) + CAST(regexp_matches({_T}, 'auVar\\d+') AS INT) >= 2 AS is_simd FROM now")
def simd_detection(s, d):
    return current_functions(s, d, ["pseudocode"]).select("fn_id", X.is_simd(F.col("pseudocode")).alias("is_simd"))
