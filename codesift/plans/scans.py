"""Registered scan queries over the synthetic corpus and their DuckDB oracles.

Each ``q_*`` takes ``(spark, sf_dir)`` and returns a DataFrame; each
``sql_*`` returns DuckDB SQL over the driver tables with the same columns.
Confidence is rounded to 6 places on both sides (DuckDB literals are
decimals; the doubles agree to far more than that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import report as R
from ..sources import catalog as CAT
from . import corpus as C
from .sqltext import all_matches_sql, conf_sql, q, values


def _round(df: DataFrame) -> DataFrame:
    if "confidence" in df.columns:
        df = df.withColumn("confidence", F.round("confidence", 6))
    return df


def _corpus(spark, sf_dir):
    files = C.syn_files(spark, sf_dir)
    return files, C.syn_lines(spark, sf_dir, files)


# --- D3 line scans -----------------------------------------------------------------

def q_scan_python_lines(spark, sf_dir):
    _, lines = _corpus(spark, sf_dir)
    return _round(D.detect_lines(lines, CAT.PYTHON_CATALOG, "G-py", "python", D.PY_EXTS))


def q_scan_javascript_lines(spark, sf_dir):
    _, lines = _corpus(spark, sf_dir)
    return _round(D.detect_lines(lines, CAT.JAVASCRIPT_CATALOG, "G-js", "javascript", D.JS_EXTS))


def _catalog_values(cat, skip_non_re2=True):
    from ..functions.regex import re2_compatible
    rows = []
    for sig_id, name, sev, _d, pats in cat:
        for i, p in enumerate(pats):
            if skip_non_re2 and not re2_compatible(p):
                continue
            rows.append((sig_id, name, sev, i, p, len(p.encode("utf-8"))))
    return values(rows, ["sig_id", "name", "severity", "pattern_ord", "pattern", "plen"])


def _ext_sql(path: str, exts) -> str:
    return f"regexp_extract({path}, '(\\.[^./]*)$', 1) IN ({', '.join(q(e) for e in exts)})"


def _line_scan_sql(cat, rule, detector, exts) -> str:
    return f"WITH {C.oracle_lines_sql()}\n" + _line_scan_body(cat, rule, detector, exts)


def _line_scan_body(cat, rule, detector, exts) -> str:
    return f"""SELECT {q(detector)} AS detector, p.sig_id, p.name, p.severity, l.path,
       l.line_no AS line_start, l.line_no AS line_end, l.text AS matched_code,
       round({conf_sql('l.text', 'p.plen', rule)}, 6) AS confidence
FROM syn_lines l JOIN {_catalog_values(cat)} p ON regexp_matches(l.text, p.pattern)
WHERE {_ext_sql('l.path', exts)}"""


def sql_scan_python_lines():
    return _line_scan_sql(CAT.PYTHON_CATALOG, "G-py", "python", D.PY_EXTS)


def sql_scan_javascript_lines():
    return _line_scan_sql(CAT.JAVASCRIPT_CATALOG, "G-js", "javascript", D.JS_EXTS)


# --- J11 with a catalogue that grows with the tables --------------------------------

SUPPLIER_PATTERNS = [r"os\.system\s*\(\s*cmd{k}\)", r"(?:password|passwd)\s*=\s*\"pw{k}\""]


def derived_catalogue(spark, sf_dir) -> DataFrame:
    """A catalogue of two patterns per supplier, which occur, and one per part,
    which do not: more than one projection's worth from sf0.01 on."""
    k = F.col("k").cast("string")
    pattern = lambda p: F.concat(F.lit(p.split("{k}")[0]), k, F.lit(p.split("{k}")[1]))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k")).select(
        F.concat(F.lit("S"), k).alias("sig_id"), F.posexplode(F.array(*map(pattern, SUPPLIER_PATTERNS))).alias("pattern_ord", "pattern"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")).select(
        F.concat(F.lit("P"), k).alias("sig_id"), F.lit(0).alias("pattern_ord"), pattern(r"part{k}\s*\(").alias("pattern"))
    return suppliers.unionByName(parts).select("sig_id", F.lit("derived").alias("name"), F.lit("high").alias("severity"), "pattern_ord", "pattern")


def q_catalogue_lines(spark, sf_dir):
    """D3 through the literal-factor index."""
    _, lines = _corpus(spark, sf_dir)
    return _round(D.detect_lines(lines, derived_catalogue(spark, sf_dir), "G-py", "derived"))


def sql_catalogue_lines():
    hit = f"""SELECT 'derived' AS detector, 'S' || s_suppkey AS sig_id, 'derived' AS name, 'high' AS severity, path, line_no AS line_start,
  line_no AS line_end, text AS matched_code, round({conf_sql('text', 'plen', 'G-py')}, 6) AS confidence
FROM (SELECT *, length(regexp_extract(text, '{{found}}', 1)) + {{fixed}} AS plen FROM syn_lines) l
JOIN supplier ON regexp_extract(text, '{{found}}', 1) = CAST(s_suppkey AS VARCHAR)"""
    found = [r"os\.system\(cmd([0-9]+)\)", r'password = "pw([0-9]+)"']
    return f"WITH {C.oracle_lines_sql()}\n" + "\nUNION ALL\n".join(
        hit.format(found=f, fixed=len(p) - len("{k}")) for f, p in zip(found, SUPPLIER_PATTERNS))


def q_catalogue_first(spark, sf_dir):
    """D4 through the literal-factor index."""
    files, _ = _corpus(spark, sf_dir)
    signatures = derived_catalogue(spark, sf_dir).groupBy("sig_id", "name", "severity").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pattern_ord", "pattern"))), lambda x: x["pattern"]).alias("code_patterns")) \
        .withColumn("affected_languages", F.array(F.lit("python")))
    return D.detect_first(files, signatures, context_lines=0).select("path", "sig_id", "pattern_ord", "line_start", "line_end", "matched_code")


def sql_catalogue_first():
    hit = """SELECT path, sig_id, {ord} AS pattern_ord, min(line_no) AS line_start, min(line_no) AS line_end, arg_min(text, line_no) AS matched_code
FROM (SELECT path, line_no, text, 'S' || s_suppkey AS sig_id FROM syn_lines JOIN supplier
      ON regexp_extract(text, '{found}', 1) = CAST(s_suppkey AS VARCHAR) WHERE path LIKE '%.py') GROUP BY path, sig_id"""
    found = [r"os\.system\(cmd([0-9]+)\)", r'password = "pw([0-9]+)"']
    return f"WITH {C.oracle_lines_sql()}\n" + "\nUNION ALL\n".join(hit.format(ord=k, found=f) for k, f in enumerate(found))


# --- D5 / D6 block checks ------------------------------------------------------------

def q_block_checks_python(spark, sf_dir):
    files, _ = _corpus(spark, sf_dir)
    return _round(D.block_checks(files, "python"))


def q_block_checks_javascript(spark, sf_dir):
    files, _ = _corpus(spark, sf_dir)
    return _round(D.block_checks(files, "javascript"))


def _block_sql(language: str) -> str:
    return f"WITH {C.oracle_files_sql()}\n" + _block_body(language)


def _block_body(language: str) -> str:
    table = CAT.PYTHON_BLOCK_CHECKS if language == "python" else CAT.JAVASCRIPT_BLOCK_CHECKS
    exts = D.PY_EXTS if language == "python" else D.JS_EXTS
    pats = values([(s, n, sev, p, c, suf) for s, n, sev, _d, p, c, suf in table],
                  ["sig_id", "name", "severity", "pattern", "conf", "suffix"])
    files = f"(SELECT path, content FROM syn_files WHERE {_ext_sql('path', exts)})"
    return f"""SELECT {q(language)} AS detector, sig_id, name, severity, path, line_start, line_start AS line_end,
       mtext || suffix AS matched_code, round(conf, 6) AS confidence
FROM {all_matches_sql(files, pats)} m"""


def sql_block_checks_python():
    return _block_sql("python")


def sql_block_checks_javascript():
    return _block_sql("javascript")


# --- D9 + F1: the Go directory scan -----------------------------------------------

def go_scan(spark, sf_dir) -> DataFrame:
    files, lines = _corpus(spark, sf_dir)
    return D.go_directory_scan(files, lines, 0.7)


def q_go_directory_scan(spark, sf_dir):
    return _round(go_scan(spark, sf_dir))


def _go_scan_cte() -> str:
    """The D9 result as a CTE named ``scan`` (needs syn_lines/syn_files)."""
    py = _line_scan_body(CAT.PYTHON_CATALOG, "G-py", "python", D.PY_EXTS)
    js = _line_scan_body(CAT.JAVASCRIPT_CATALOG, "G-js", "javascript", D.JS_EXTS)
    pyb = _block_body("python")
    jsb = _block_body("javascript")
    return f"""scan AS (
  SELECT * FROM ({py}) UNION ALL SELECT * FROM ({pyb})
  UNION ALL SELECT * FROM ({js}) UNION ALL SELECT * FROM ({jsb}))"""


def _with_scan() -> str:
    return f"WITH {C.oracle_files_sql()},\n{_go_scan_cte()},\nm AS (SELECT * FROM scan WHERE confidence >= 0.7)"


def sql_go_directory_scan():
    return _with_scan() + "\nSELECT * FROM m"


# --- A1-A9 rollups over the D9 result --------------------------------------------

def q_severity_summary(spark, sf_dir):
    return R.severity_summary(go_scan(spark, sf_dir), R.GO_SEVERITY_KEYS)


def sql_severity_summary():
    keys = values([(k, 0) for k in R.GO_SEVERITY_KEYS], ["severity", "n"])
    return _with_scan() + f"""
SELECT severity, CAST(SUM(n) AS BIGINT) AS n FROM (
  SELECT severity, count(*) AS n FROM m GROUP BY severity
  UNION ALL SELECT severity, n FROM {keys}) GROUP BY severity"""


def q_go_summary(spark, sf_dir):
    s = R.go_summary(go_scan(spark, sf_dir))
    # map flattened to sorted text for the order-insensitive oracle compare
    return s.select("total_files", "high", "medium", "low",
                    F.array_join(F.array_sort(F.transform(F.map_entries("vulnerabilities"), lambda e: F.concat(
                        e["key"], F.lit("="), e["value"].cast("string")))), ";").alias("vulnerabilities"))


def sql_go_summary():
    return _with_scan() + """
SELECT (SELECT count(DISTINCT path) FROM m) AS total_files,
       (SELECT count(*) FROM m WHERE severity = 'high') AS high,
       (SELECT count(*) FROM m WHERE severity = 'medium') AS medium,
       (SELECT count(*) FROM m WHERE severity = 'low') AS low,
       (SELECT string_agg(name || '=' || CAST(n AS VARCHAR), ';' ORDER BY name || '=' || CAST(n AS VARCHAR))
          FROM (SELECT name, count(*) AS n FROM m GROUP BY name)) AS vulnerabilities"""


def q_totals(spark, sf_dir):
    return R.totals(go_scan(spark, sf_dir))


def sql_totals():
    return _with_scan() + "\nSELECT count(*) AS total_vulnerabilities, count(DISTINCT path) AS total_files FROM m"


def q_type_counts(spark, sf_dir):
    return R.type_counts(go_scan(spark, sf_dir))


def sql_type_counts():
    return _with_scan() + "\nSELECT name, count(*) AS n FROM m GROUP BY name"


def q_top_types(spark, sf_dir):
    return R.top_types(go_scan(spark, sf_dir), 10)


def sql_top_types():
    return _with_scan() + "\nSELECT name, count(*) AS n FROM m GROUP BY name ORDER BY n DESC, name LIMIT 10"


def q_top_files(spark, sf_dir):
    return R.top_files(go_scan(spark, sf_dir), 10)


def sql_top_files():
    return _with_scan() + "\nSELECT path, count(*) AS n FROM m GROUP BY path ORDER BY n DESC, path LIMIT 10"


def q_severity_distribution(spark, sf_dir):
    return R.severity_distribution(go_scan(spark, sf_dir))


def sql_severity_distribution():
    return _with_scan() + "\nSELECT severity, count(*) AS n FROM m GROUP BY severity"


def q_confidence_histogram(spark, sf_dir):
    return _round(R.confidence_histogram(go_scan(spark, sf_dir), 0.05)).select(
        "bucket", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


def sql_confidence_histogram():
    return _with_scan() + """
SELECT bucket, round(bucket * CAST(0.05 AS DOUBLE), 6) AS lo, round((bucket + 1) * CAST(0.05 AS DOUBLE), 6) AS hi, n
FROM (SELECT CAST(floor(round(confidence / CAST(0.05 AS DOUBLE), 9)) AS BIGINT) AS bucket, count(*) AS n FROM m GROUP BY 1)"""


def q_per_file_report(spark, sf_dir):
    rep = R.per_file_report(go_scan(spark, sf_dir))
    return rep.select("path", "n", F.array_join(F.transform("matches", lambda x: F.concat_ws(
        ":", x["line_start"].cast("string"), x["sig_id"])), ",").alias("matches"))


def sql_per_file_report():
    return _with_scan() + """
SELECT path, count(*) AS n,
       string_agg(CAST(line_start AS VARCHAR) || ':' || sig_id, ',' ORDER BY line_start, sig_id, line_end, name,
                  severity, matched_code, confidence) AS matches
FROM m GROUP BY path"""


def q_file_list(spark, sf_dir):
    return R.file_list(go_scan(spark, sf_dir))


def sql_file_list():
    return _with_scan() + "\nSELECT DISTINCT path FROM m ORDER BY path"


def q_severity_normalized(spark, sf_dir):
    """Severity mapped to one scale (broadcast of a literal table)."""
    from ..operators.detect import normalize_severity
    return normalize_severity(go_scan(spark, sf_dir)).groupBy("severity_norm", "severity_rank").agg(
        F.count(F.lit(1)).alias("n"))


def sql_severity_normalized():
    scale = values(CAT.SEVERITY_SCALE, ["severity", "severity_norm", "severity_rank"])
    return _with_scan() + f"""
SELECT coalesce(s.severity_norm, m.severity) AS severity_norm, s.severity_rank, count(*) AS n
FROM m LEFT JOIN {scale} s ON m.severity = s.severity GROUP BY 1, 2"""


# --- D2: all-match signature scan (Python CLI rule P) -------------------------------

def q_signature_scan_all(spark, sf_dir):
    files, _ = _corpus(spark, sf_dir)
    sigs = CAT.CWE_SIGNATURES["signatures"]
    cat = [(s["id"], s["name"], s["severity"], s["description"], s["code_patterns"]) for s in sigs]
    return _round(D.detect_all(files, cat, "P", "signature", 0.7))


def sql_signature_scan_all():
    rows = []
    for s in CAT.CWE_SIGNATURES["signatures"]:
        for i, p in enumerate(s["code_patterns"]):
            rows.append((s["id"], s["name"], s["severity"], i, p, len(p)))
    pats = values(rows, ["sig_id", "name", "severity", "pattern_ord", "pattern", "plen"])
    return f"""WITH {C.oracle_files_sql()}
SELECT * FROM (
SELECT 'signature' AS detector, sig_id, name, severity, path, line_start, line_end, mtext AS matched_code,
       round({conf_sql('mtext', 'plen', 'P')}, 6) AS confidence
FROM {all_matches_sql('syn_files', pats, 'sig_id, pattern_ord')} m)
WHERE confidence >= 0.7"""


# --- S6: signatures from a JSON file, then D2 ----------------------------------------

def q_signature_file_scan(spark, sf_dir):
    """S6 end to end: the CWE signature file is written as JSON, loaded with
    Spark's JSON source (defaults applied), exploded to patterns, and used
    for the all-match scan."""
    import json
    import uuid

    from ..session import ensure_checkpoint_dir, write_text_file
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/signatures-{uuid.uuid4().hex}.json"
    write_text_file(spark, path, json.dumps(CAT.CWE_SIGNATURES))
    sigs = CAT.load_signatures(spark, path)
    files, _ = _corpus(spark, sf_dir)
    return _round(D.detect_all(files, CAT.patterns_of(sigs), "P", "signature", 0.7))


def sql_signature_file_scan():
    return sql_signature_scan_all()


def q_finding_references(spark, sf_dir):
    """S6 ``references``: a signature file with references derived from the
    nations is written and loaded, and its findings are counted by reference."""
    import json
    import uuid

    from ..session import ensure_checkpoint_dir, write_text_file
    names = [r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").orderBy("n_nationkey").collect()]
    sigs = [dict(s) | ({"references": [f"https://example.org/{n}" for n in names[k::3]]} if k else {})
            for k, s in enumerate(CAT.CWE_SIGNATURES["signatures"])]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/signatures-{uuid.uuid4().hex}.json"
    write_text_file(spark, path, json.dumps({"signatures": sigs}))
    loaded = CAT.load_signatures(spark, path)
    files, _ = _corpus(spark, sf_dir)
    found = D.detect_all(files, CAT.patterns_of(loaded), "P", "signature", 0.7).groupBy("sig_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(loaded.select("sig_id", F.explode_outer("references").alias("reference")), "sig_id").select("sig_id", "reference", "n")


def sql_finding_references():
    ids = values([(s["id"], k) for k, s in enumerate(CAT.CWE_SIGNATURES["signatures"])], ["sig_id", "k"])
    return f"""WITH found AS (SELECT sig_id, count(*) AS n FROM ({sql_signature_scan_all()}) GROUP BY sig_id),
ranked AS (SELECT 'https://example.org/' || n_name AS reference, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation)
SELECT f.sig_id, reference, n FROM found f JOIN {ids} s USING (sig_id) LEFT JOIN ranked ON k > 0 AND r >= k AND (r - k) % 3 = 0"""


# --- A11 ------------------------------------------------------------------------------

def _catalog_signatures(spark):
    py = CAT.builtin_signatures(spark, "python")
    js = CAT.builtin_signatures(spark, "javascript")
    blocks = [(s, n, sev, d, None, None, [], [], [], []) for s, n, sev, d, *_ in
              CAT.PYTHON_BLOCK_CHECKS + CAT.JAVASCRIPT_BLOCK_CHECKS]
    return py.unionByName(js).unionByName(spark.createDataFrame(blocks, CAT.SIGNATURE_SCHEMA))


def q_report_rows(spark, sf_dir):
    return _round(R.report_rows(go_scan(spark, sf_dir), _catalog_signatures(spark)))


def sql_report_rows():
    rows = [(s, d) for s, _n, _sev, d, _p in CAT.PYTHON_CATALOG + CAT.JAVASCRIPT_CATALOG]
    rows += [(s, d) for s, _n, _sev, d, *_ in CAT.PYTHON_BLOCK_CHECKS + CAT.JAVASCRIPT_BLOCK_CHECKS]
    sig = values(rows, ["sig_id", "description"])
    return _with_scan() + f"""
SELECT m.sig_id AS id, m.name, s.description, m.severity, CAST(NULL AS VARCHAR) AS cwe_id,
       CAST(NULL AS VARCHAR) AS cve_id, m.path AS file, m.line_start, m.line_end, m.matched_code, m.confidence
FROM m LEFT JOIN {sig} s ON s.sig_id = m.sig_id"""


# --- D2 with rule G-vul (Go signature detector) + T12 ------------------------------

def _go_catalog():
    return [(i, n, sev, "", pats) for i, n, sev, pats in CAT.GO_SIGNATURES]


def q_go_signature_scan(spark, sf_dir):
    """The Go signature detector: every match in the whole file, rule G-vul,
    kept at >= 0.7; severities (Chinese labels) normalised (T12)."""
    files, _ = _corpus(spark, sf_dir)
    m = D.detect_all(files, _go_catalog(), "G-vul", "go-signature", 0.7)
    return _round(D.normalize_severity(m)).select(
        "sig_id", "name", "severity", "severity_norm", "severity_rank", "path", "line_start", "line_end",
        "matched_code", "confidence")


def sql_go_signature_scan():
    rows = [(i, n, sev, k, p, len(p.encode("utf-8"))) for i, n, sev, pats in CAT.GO_SIGNATURES
            for k, p in enumerate(pats)]
    pats = values(rows, ["sig_id", "name", "severity", "pattern_ord", "pattern", "plen"])
    scale = values(CAT.SEVERITY_SCALE, ["severity", "severity_norm", "severity_rank"])
    return f"""WITH {C.oracle_files_sql()},
m AS (SELECT sig_id, name, severity, path, line_start, line_end, mtext AS matched_code,
             round({conf_sql('mtext', 'plen', 'G-vul')}, 6) AS confidence
      FROM {all_matches_sql('syn_files', pats, 'sig_id, pattern_ord')} x)
SELECT m.sig_id, m.name, m.severity, coalesce(s.severity_norm, m.severity) AS severity_norm, s.severity_rank,
       m.path, m.line_start, m.line_end, m.matched_code, m.confidence
FROM m LEFT JOIN {scale} s ON s.severity = m.severity WHERE m.confidence >= 0.7"""


# --- X1: a user detector registered next to the built-ins ------------------------------

def q_registered_detectors_scan(spark, sf_dir):
    """X1 + D9: the default registry (python, javascript) plus a registered
    detector running the CWE signature all-match scan on Python files."""
    from ..operators.registry import default_registry, register_detector
    sigs = CAT.CWE_SIGNATURES["signatures"]
    cat = [(s["id"], s["name"], s["severity"], s["description"], s["code_patterns"]) for s in sigs]
    reg = register_detector(default_registry(), "cwe", ["py"],
                            lambda files: D.detect_all(files, cat, "P", "cwe", 0.0))
    files, _ = _corpus(spark, sf_dir)
    return _round(reg.run(files.select("path", "content"), 0.7))


def sql_registered_detectors_scan():
    rows = []
    for s in CAT.CWE_SIGNATURES["signatures"]:
        for i, p in enumerate(s["code_patterns"]):
            rows.append((s["id"], s["name"], s["severity"], i, p, len(p)))
    pats = values(rows, ["sig_id", "name", "severity", "pattern_ord", "pattern", "plen"])
    py = "(SELECT path, content FROM syn_files WHERE ends_with(path, '.py'))"
    return _with_scan() + f""",
cwe AS (SELECT 'cwe' AS detector, sig_id, name, severity, path, line_start, line_end, mtext AS matched_code,
               round({conf_sql('mtext', 'plen', 'P')}, 6) AS confidence
        FROM {all_matches_sql(py, pats, 'sig_id, pattern_ord')} x)
SELECT * FROM m UNION ALL SELECT * FROM cwe WHERE confidence >= 0.7"""
