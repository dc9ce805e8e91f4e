"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

_REAL = """
calls AS (SELECT 'elapsed_us' AS metric, label, func_id, CAST(run_ts AS DATE) AS day, elapsed_us + 0.0 AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY label DESC, func_id DESC, CAST(run_ts AS DATE) DESC, elapsed_us DESC) AS rn
    FROM execute_result WHERE elapsed_us IS NOT NULL AND NOT isnan(elapsed_us) AND NOT isinf(elapsed_us) AND elapsed_us >= 0 AND probe_id IS NOT NULL) WHERE rn = 1),
solver AS (SELECT 'eval_ms' AS metric, label, CAST(NULL AS VARCHAR) AS func_id, TRY_CAST(run_day AS DATE) AS day, eval_ms + 0.0 AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY timing_id ORDER BY label DESC, TRY_CAST(run_day AS DATE) DESC, eval_ms DESC) AS rn
    FROM constraint_timing WHERE eval_ms IS NOT NULL AND NOT isnan(eval_ms) AND NOT isinf(eval_ms) AND eval_ms >= 0 AND timing_id IS NOT NULL) WHERE rn = 1),
one AS (SELECT * FROM calls UNION ALL SELECT * FROM solver)"""

_TERMS = r"""
now AS (SELECT fn_id, name FROM (SELECT fn_id, name, row_number() OVER (PARTITION BY fn_id ORDER BY dump_ts DESC, name DESC NULLS LAST) AS rn FROM calltree) WHERE rn = 1),
words AS (SELECT 'name' AS field_name, fn_id AS record, unnest(regexp_extract_all(lower(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z]+')) AS term FROM now),
cls AS (SELECT cls_id, func_class FROM (SELECT cls_id, func_class, row_number() OVER (PARTITION BY cls_id ORDER BY classified_ts DESC, func_class DESC NULLS LAST) AS rn FROM classify_result) WHERE rn = 1),
classes AS (SELECT 'func_class' AS field_name, cls_id AS record, lower(regexp_replace(func_class, '^\s+|\s+$', '', 'g')) AS term FROM cls),
tokens AS (SELECT * FROM words WHERE length(term) >= 3 UNION ALL SELECT * FROM classes WHERE term IS NOT NULL AND term <> ''),
totals AS (SELECT 'name' AS field_name, count(*) AS total FROM now UNION ALL SELECT 'func_class', count(*) FROM classes WHERE term <> ''),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM tokens GROUP BY ALL),
marks AS (SELECT c.*, total, CASE WHEN records <= 2 THEN 'rare' WHEN records > total * 0.1 THEN 'common' END AS mark FROM counted c JOIN totals USING (field_name))"""

_BODIES = r"""
now AS (SELECT fn_id, pseudocode FROM (SELECT fn_id, pseudocode, row_number() OVER (PARTITION BY fn_id ORDER BY dump_ts DESC) AS rn FROM calltree) WHERE rn = 1 AND pseudocode IS NOT NULL),
w AS (SELECT fn_id, regexp_extract_all(pseudocode, '[A-Za-z0-9_]+') AS t FROM now), g AS (SELECT DISTINCT fn_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM w, unnest(range(1, len(t) - 1)) AS u(i) WHERE len(t) >= 20),
n AS (SELECT fn_id, count(*) AS n FROM g GROUP BY fn_id), o AS (SELECT a.fn_id AS a, b.fn_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.fn_id < b.fn_id GROUP BY ALL)"""

SQL = {
    "p5_found": f"WITH {_BODIES} SELECT a AS fn_id_a, b AS fn_id_b FROM o JOIN n x ON x.fn_id = a JOIN n y ON y.fn_id = b WHERE o * 5 >= 3 * (x.n + y.n - o)",
    "p3_counts": f"WITH {_REAL} SELECT metric, label, func_id, day, value, count(*) AS n FROM one GROUP BY ALL",
    "p3_percentiles": f"""WITH {_REAL},
ranked AS (SELECT metric, label, func_id, value, row_number() OVER (PARTITION BY metric, label, func_id ORDER BY value) AS r, count(*) OVER (PARTITION BY metric, label, func_id) AS n FROM one)
SELECT metric, label, func_id, n, p, value FROM ranked, (VALUES (500), (900), (950), (990)) AS t(p) WHERE r = (n * p + 999) // 1000""",
    "p6_terms": f"WITH {_TERMS} SELECT field_name, term, occurrences, records, total, mark FROM marks",
    "p6_found": f"WITH {_TERMS} SELECT field_name, term, mark FROM marks WHERE mark IS NOT NULL",
}
