"""Registered security-check queries (K1-K9) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from ..sources import catalog as CAT
from . import corpus as C
from .sqltext import all_matches_sql, q, values


def _pattern_table(dialect: str, checks):
    rows = []
    for check in checks:
        for i, p in enumerate(CAT.SECURITY_PATTERNS[dialect][check]):
            rows.append((check, i, p))
    return values(rows, ["check", "pattern_ord", "pattern"])


def _findings_body(files_sql: str, dialect: str, checks) -> str:
    marker = CAT.RANDOM_SAFE_MARKER[dialect]
    return f"""SELECT path, "check", pattern_ord, mtext AS matched, "offset", line_start AS line_no
FROM {all_matches_sql(files_sql, _pattern_table(dialect, checks), '"check", pattern_ord')} m
WHERE NOT ("check" = 'random_generation' AND contains(mtext, {q(marker)}))"""


PY_CHECKS = [c for c in CAT.PATTERN_CHECKS if c in CAT.SECURITY_PATTERNS["python"]]


def q_security_checks_python(spark, sf_dir):
    return K.security_check(C.syn_files(spark, sf_dir), PY_CHECKS, "python")


def sql_security_checks_python():
    return f"WITH {C.oracle_files_sql()}\n" + _findings_body("syn_files", "python", PY_CHECKS)


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


def q_sensitive_data_documents(spark, sf_dir):
    """K4 (Go dialect, case-insensitive first pattern) over real prose."""
    return K.security_check(_documents(spark, sf_dir), ["sensitive_data"], "go")


def sql_sensitive_data_documents():
    files = "(SELECT CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents)"
    return _findings_body(files, "go", ["sensitive_data"])


def q_sensitive_data_pages(spark, sf_dir):
    """K4 (Python tables) over raw web pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return K.security_check(pages, ["sensitive_data"], "python")


def sql_sensitive_data_pages():
    files = "(SELECT CAST(page_id AS VARCHAR) AS path, html AS content FROM pages)"
    return _findings_body(files, "python", ["sensitive_data"])


def _details_text(col):
    """The details map as sorted ``text@position`` pairs; NULL when empty."""
    text = F.array_join(F.array_sort(F.transform(F.map_entries(col), lambda e: F.concat(
        e["key"], F.lit("@"), e["value"].cast("string")))), ";")
    return F.when(F.size(col) > 0, text)


def q_security_full_check(spark, sf_dir):
    """K9 over the six pattern checks of every synthetic file (``security_full_check_all``
    adds the two call checks over the Python files)."""
    from pyspark import StorageLevel
    files = C.syn_files(spark, sf_dir).select("path", "content").persist(StorageLevel.MEMORY_AND_DISK)
    findings = K.security_check(files, PY_CHECKS, "python")
    out = K.full_check(files, findings, PY_CHECKS)
    return out.select("path", "check", "has_issues", "n_issues", _details_text("details").alias("details"))


def sql_security_full_check():
    checks = values([(c,) for c in PY_CHECKS], ["check"])
    return f"""WITH {C.oracle_files_sql()},
f AS ({_findings_body("syn_files", "python", PY_CHECKS)}),
t AS (SELECT path, "check", matched, arg_max("offset", pattern_ord * 1000000000 + "offset") AS p, count(*) AS k
      FROM f GROUP BY 1, 2, 3),
pc AS (SELECT path, "check", SUM(k) AS n, string_agg(matched || '@' || CAST(p AS VARCHAR), ';'
         ORDER BY matched || '@' || CAST(p AS VARCHAR)) AS details FROM t GROUP BY 1, 2)
SELECT s.path, c."check", coalesce(pc.n, 0) > 0 AS has_issues, CAST(coalesce(pc.n, 0) AS BIGINT) AS n_issues,
       pc.details
FROM syn_files s CROSS JOIN {checks} c LEFT JOIN pc ON pc.path = s.path AND pc."check" = c."check\""""


def q_security_full_check_all(spark, sf_dir):
    """K9 with all eight static checks over the synthetic Python files:
    six pattern checks plus the two call checks (one ast parse; a file with
    an ``except:`` line does not parse and counts one issue per call check)."""
    from pyspark import StorageLevel
    files = C.syn_files(spark, sf_dir).where(F.col("path").endswith(".py")).select("path", "content") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    findings = K.security_check(files, PY_CHECKS, "python").unionByName(K.call_checks(files))
    out = K.full_check(files, findings, K.ALL_CHECKS)
    return out.select("path", "check", "has_issues", "n_issues", _details_text("details").alias("details"))


def sql_security_full_check_all():
    checks = values([(c,) for c in K.ALL_CHECKS], ["check"])
    files = "(SELECT path, content FROM syn_files WHERE ends_with(path, '.py'))"
    return f"""WITH {C.oracle_files_sql()},
pf AS ({_findings_body(files, "python", PY_CHECKS)}),
py AS (SELECT s.* FROM syn_lines s WHERE ends_with(path, '.py')),
bad AS (SELECT DISTINCT path FROM py WHERE text = 'except:'),
cf AS (
  SELECT path, 'sandbox_escape' AS "check", 0 AS pattern_ord,
         regexp_extract(text, '[A-Za-z_][A-Za-z0-9_.]*\\(.*\\)', 0) AS matched,
         CAST(NULL AS INT) AS "offset", line_no
  FROM py WHERE path NOT IN (SELECT path FROM bad)
    AND regexp_matches(text, '(os\\.system|subprocess\\.call|eval)\\(')
  UNION ALL
  SELECT path, c, -1, NULL, NULL, NULL FROM bad, (VALUES ('input_validation'), ('sandbox_escape')) v(c)),
f AS (SELECT * FROM pf UNION ALL SELECT * FROM cf),
t AS (SELECT path, "check", matched, arg_max(coalesce("offset", line_no), pattern_ord * 1000000000 + coalesce("offset", line_no)) AS p,
             count(*) AS k FROM f GROUP BY 1, 2, 3),
pc AS (SELECT path, "check", SUM(k) AS n,
              string_agg(matched || '@' || CAST(p AS VARCHAR), ';' ORDER BY matched || '@' || CAST(p AS VARCHAR))
                FILTER (WHERE matched IS NOT NULL) AS details
       FROM t GROUP BY 1, 2)
SELECT s.path, c."check", coalesce(pc.n, 0) > 0 AS has_issues, CAST(coalesce(pc.n, 0) AS BIGINT) AS n_issues,
       pc.details
FROM {files} s CROSS JOIN {checks} c LEFT JOIN pc ON pc.path = s.path AND pc."check" = c."check\"
"""


def q_security_full_check_files(spark, sf_dir):
    """K9 with all eight checks over every file of the corpus, one projection."""
    out = K.full_check_files(C.syn_files(spark, sf_dir).select("path", "content"))
    return out.select("path", "check", "has_issues", "n_issues", _details_text("details").alias("details"))


def sql_security_full_check_files():
    return sql_security_full_check_all().replace(" WHERE ends_with(path, '.py')", "")
