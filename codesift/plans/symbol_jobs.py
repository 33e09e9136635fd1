"""Registered call / symbol queries.

Input: the synthetic corpus's Python lines as one-line files (``path:line``)
— whole synthetic files contain ``except:`` lines that are not valid Python,
and a file that does not parse yields no calls.  Every line template parses
except ``except:``.

The DuckDB oracles render calls with a small regex renderer that is exact on
this corpus (positional constants and names, keyword arguments dropped,
other expressions blank / ``...``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import detect as D
from ..operators import symbols as SY
from ..sources import catalog as CAT
from . import corpus as C
from .sqltext import conf_sql, q, values


def _line_files(spark, sf_dir):
    lines = C.syn_lines(spark, sf_dir).where(D.ext_filter(F.col("path"), D.PY_EXTS))
    return lines.select(F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("path"),
                        F.col("text").alias("content"))


def _calls(spark, sf_dir):
    """C1 over the one-line files, persisted: the matchers read the call
    table several times (regex hits, distinct texts, join back) and the
    table comes from a Python parse, so it is computed once per query
    (recomputable from lineage if an executor is lost)."""
    from pyspark import StorageLevel
    return SY.call_sites(_line_files(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)


def _cwe_catalog():
    return [(s["id"], s["name"], s["severity"], s["description"], s["code_patterns"])
            for s in CAT.CWE_SIGNATURES["signatures"]]


CALL_RE = r"([A-Za-z_][A-Za-z0-9_.]*)\((.*)\)"


def _calls_cte() -> str:
    """``calls(path, lineno, func_name, full_call_exact, full_call_similar, source)``."""
    part = ("CASE WHEN regexp_full_match(a, '-?[0-9]+') THEN a "
            "WHEN regexp_full_match(a, '\"[^\"]*\"') OR regexp_full_match(a, '''[^'']*''') "
            "THEN substr(a, 2, length(a) - 2) "
            "WHEN regexp_full_match(a, '[A-Za-z_][A-Za-z0-9_]*') THEN a ELSE {other} END")
    exact = part.format(other="''")
    similar = part.format(other="'...'")
    return f"""{C.oracle_lines_sql()},
lf AS (SELECT path || ':' || CAST(line_no AS VARCHAR) AS path, text FROM syn_lines
       WHERE regexp_extract(path, '(\\.[^./]*)$', 1) = '.py' AND regexp_matches(text, '{CALL_RE}')),
c0 AS (SELECT path, text, regexp_extract(text, '{CALL_RE}', 1) AS func_name,
              list_filter(string_split(regexp_extract(text, '{CALL_RE}', 2), ', '),
                          lambda a: length(a) > 0 AND NOT regexp_matches(a, '^[A-Za-z_][A-Za-z0-9_]*=')) AS args
       FROM lf),
calls AS (SELECT path, 1 AS lineno, func_name,
    func_name || '(' || array_to_string(list_transform(args, lambda a: {exact}), '') || ')' AS full_call_exact,
    func_name || '(' || rtrim(array_to_string(list_transform(args, lambda a: ({similar}) || ', '), ''), ', ') || ')'
      AS full_call_similar,
    regexp_extract(text, '[A-Za-z_][A-Za-z0-9_.]*\\(.*\\)', 0) AS source
  FROM c0)"""


def q_call_sites(spark, sf_dir):
    return SY.call_sites(_line_files(spark, sf_dir)).select(
        "path", "lineno", "func_name", "full_call_exact", "full_call_similar")


def sql_call_sites():
    return f"WITH {_calls_cte()}\nSELECT path, lineno, func_name, full_call_exact, full_call_similar FROM calls"


def q_parse_errors(spark, sf_dir):
    return SY.parse_errors(_line_files(spark, sf_dir)).select("path")


def sql_parse_errors():
    return f"""WITH {C.oracle_lines_sql()}
SELECT path || ':' || CAST(line_no AS VARCHAR) AS path FROM syn_lines
WHERE regexp_extract(path, '(\\.[^./]*)$', 1) = '.py' AND text = 'except:'"""


def q_symbols(spark, sf_dir):
    return SY.symbol_table(_line_files(spark, sf_dir)).select("path", "kind", "name", "lineno", "value")


def _symbols_cte() -> str:
    return f"""{C.oracle_lines_sql()},
lf AS (SELECT path || ':' || CAST(line_no AS VARCHAR) AS path, text FROM syn_lines
       WHERE regexp_extract(path, '(\\.[^./]*)$', 1) = '.py'),
symbols AS (
  SELECT path, 'import' AS kind, regexp_extract(text, '^import ([A-Za-z_][A-Za-z0-9_]*)$', 1) AS name,
         1 AS lineno, CAST(NULL AS VARCHAR) AS value FROM lf WHERE regexp_matches(text, '^import [A-Za-z_][A-Za-z0-9_]*$')
  UNION ALL
  SELECT path, 'variable', regexp_extract(text, '^([A-Za-z_][A-Za-z0-9_]*) = ', 1), 1,
         CASE WHEN regexp_full_match(regexp_extract(text, ' = (.*)$', 1), '"[^"]*"')
              THEN regexp_extract(text, ' = "([^"]*)"$', 1) END
  FROM lf WHERE regexp_matches(text, '^[A-Za-z_][A-Za-z0-9_]* = '))"""


def sql_symbols():
    return f"WITH {_symbols_cte()}\nSELECT path, kind, name, lineno, value FROM symbols"


def q_context_counts(spark, sf_dir):
    return SY.context_counts(SY.symbol_table(_line_files(spark, sf_dir)))


def sql_context_counts():
    return f"""WITH {_symbols_cte()}
SELECT path, count(*) FILTER (WHERE kind = 'import') AS n_imports,
       count(*) FILTER (WHERE kind = 'function') AS n_functions,
       count(*) FILTER (WHERE kind = 'class') AS n_classs,
       count(*) FILTER (WHERE kind = 'variable') AS n_variables FROM symbols GROUP BY path"""


def q_file_complexity(spark, sf_dir):
    files = C.syn_files(spark, sf_dir).where(D.ext_filter(F.col("path"), D.PY_EXTS))
    return SY.complexity(files, SY.symbol_table(files))


def sql_file_complexity():
    return f"""WITH {C.oracle_files_sql()}
SELECT path, CAST(0 AS BIGINT) AS complexity FROM syn_files WHERE regexp_extract(path, '(\\.[^./]*)$', 1) = '.py'"""


def q_exact_calls(spark, sf_dir):
    m = SY.match_calls(_calls(spark, sf_dir), _cwe_catalog(), 0.7)
    return m.withColumn("confidence", F.round("confidence", 6))


def sql_exact_calls():
    rows = [(s, n, sev, i, p, len(p)) for s, n, sev, _d, pats in _cwe_catalog() for i, p in enumerate(pats)]
    pats = values(rows, ["sig_id", "name", "severity", "pattern_ord", "pattern", "plen"])
    return f"""WITH {_calls_cte()}
SELECT * FROM (
  SELECT c.path, c.lineno, p.sig_id, p.name, p.severity, p.pattern_ord, c.full_call_exact AS matched_code,
         round({conf_sql('c.full_call_exact', 'p.plen', 'P')}, 6) AS confidence
  FROM calls c JOIN {pats} p ON regexp_matches(c.full_call_exact, '(?i)' || p.pattern))
WHERE confidence >= 0.7"""


def q_call_name_matches(spark, sf_dir):
    return SY.match_call_names(SY.call_sites(_line_files(spark, sf_dir)), CAT.PYTHON_CATALOG)


def sql_call_name_matches():
    rows = [(s, n, sev, i, p) for s, n, sev, _d, pats in CAT.PYTHON_CATALOG for i, p in enumerate(pats)]
    pats = values(rows, ["sig_id", "name", "severity", "pattern_ord", "pattern"])
    return f"""WITH {_calls_cte()}
SELECT c.path, c.lineno, p.sig_id, p.name, p.severity, p.pattern_ord, c.func_name AS matched_code,
       CAST(0.9 AS DOUBLE) AS confidence
FROM calls c JOIN {pats} p ON regexp_matches(c.func_name, p.pattern)"""


def q_similar_calls(spark, sf_dir):
    """D8 + J14: regex hit (rule P) or LCS similarity per call and pattern."""
    m = SY.match_similar_calls(_calls(spark, sf_dir), _cwe_catalog(), 0.7)
    return m.withColumn("confidence", F.round("confidence", 6))


def q_sandbox_escape_calls(spark, sf_dir):
    return K.sandbox_escape(SY.parse_calls(_line_files(spark, sf_dir))).select("path", "check", "matched", "line_no")


def sql_sandbox_escape_calls():
    attrs = ", ".join(q(a) for a in CAT.SANDBOX_ATTRIBUTE_CALLS)
    names = ", ".join(q(a) for a in CAT.SANDBOX_NAME_CALLS)
    return f"""WITH {_calls_cte()}
SELECT path, 'sandbox_escape' AS "check", source AS matched, lineno AS line_no FROM calls
WHERE (contains(func_name, '.') AND regexp_extract(func_name, '([^.]*)$', 1) IN ({attrs}))
   OR (NOT contains(func_name, '.') AND func_name IN ({names}))"""


def q_js_call_sites(spark, sf_dir):
    """C1 (regex form) over the synthetic JavaScript files."""
    files = C.syn_files(spark, sf_dir).where(D.ext_filter(F.col("path"), D.JS_EXTS))
    return SY.call_sites_regex(files)


def sql_js_call_sites():
    return f"""WITH {C.oracle_lines_sql()}
SELECT path, line_no AS lineno, func_name,
       CASE WHEN contains(func_name, '.') THEN split_part(func_name, '.', 1) END AS base,
       CASE WHEN contains(func_name, '.') THEN split_part(func_name, '.', 2) END AS attr
FROM (SELECT path, line_no, unnest(regexp_extract_all(text, '{SY.CALL_NAME_PATTERN}', 1)) AS func_name
      FROM syn_lines WHERE regexp_extract(path, '(\\.[^./]*)$', 1) IN ('.js', '.jsx', '.ts', '.tsx'))"""


# --- Whole files: C2 with scopes, C3, C4, C1 and K5 over the module view ------------------

def _module_symbols(spark, sf_dir):
    return SY.symbol_table(C.syn_modules(spark, sf_dir))


def q_symbols_files(spark, sf_dir):
    """C2 over whole files, with scopes; each file has a path of its own."""
    return SY.with_scopes(SY.symbol_table(C.syn_modules(spark, sf_dir), scopes=True)).select(
        "path", "kind", "name", "lineno", "end_lineno", "value", F.array_join("items", ",").alias("items"), "docstring",
        F.array_join("decorators", ",").alias("decorators"), F.array_join("methods", ",").alias("methods"), "scope", "method")


HEAD_LINES = len(C.MODULE_HEAD)


def _modules_cte() -> str:
    """``mod``: files; ``step``: functions, each of six lines from ``pos``."""
    return f"""{C.oracle_files_sql()},
mod AS (SELECT regexp_replace(path, '\\.js$', '.py') AS path, CAST(file_id AS VARCHAR) AS k, n_lines FROM syn_files),
step AS (SELECT regexp_replace(path, '\\.js$', '.py') AS path, 'run_' || line_no AS fn, CAST({HEAD_LINES} + 6 * (line_no - 1) + 1 AS INT) AS pos, text,
                text <> 'except:' AS plain FROM syn_lines)"""


def _module_symbols_sql() -> str:
    fixed = [("import", "'sys'", 2, 2, "'system'", "''", "NULL", "NULL", "NULL", "''", "FALSE"),
             ("import", "'json'", 3, 3, "'parse'", "'loads'", "NULL", "NULL", "NULL", "''", "FALSE"),
             ("import", "'json'", 3, 3, "NULL", "'dumps'", "NULL", "NULL", "NULL", "''", "FALSE"),
             ("variable", "'LIMIT'", 4, 4, "CAST(n_lines AS VARCHAR)", "''", "NULL", "NULL", "NULL", "''", "FALSE"),
             ("variable", "'NAMES'", 5, 5, "'[''a'', ' || n_lines || ']'", "''", "NULL", "NULL", "NULL", "''", "FALSE"),
             ("class", "'Base' || k", 9, 16, "NULL", "'object,Mixin'", "'Base of ' || k || '.'", "'register,app.route'", "'__init__,load'", "''", "FALSE"),
             ("function", "'__init__'", 11, 12, "NULL", "'self,size'", "NULL", "''", "NULL", "'Base' || k", "TRUE"),
             ("function", "'load'", 14, 16, "'str'", "'path'", "NULL", "'staticmethod'", "NULL", "'Base' || k", "TRUE"),
             ("variable", "'kind'", 15, 15, "'text'", "''", "NULL", "NULL", "NULL", "'Base' || k || '.load'", "FALSE")]
    rows = [f"SELECT path, '{kind}' AS kind, {name} AS name, CAST({a} AS INT) AS lineno, CAST({b} AS INT) AS end_lineno, CAST({value} AS VARCHAR) AS value, "
            f"{items} AS items, CAST({doc} AS VARCHAR) AS docstring, coalesce(CAST({marks} AS VARCHAR), '') AS decorators, "
            f"coalesce(CAST({own} AS VARCHAR), '') AS methods, {scope} AS scope, {method} AS method FROM mod"
            for kind, name, a, b, value, items, doc, marks, own, scope, method in fixed]
    tail = "'' AS items, CAST(NULL AS VARCHAR) AS docstring, '' AS decorators, '' AS methods"
    rows.append("SELECT path, 'function', fn, pos, CAST(pos + 5 AS INT), NULL, 'a,b', 'Step.', '', '', '', FALSE FROM step")
    rows.append(f"SELECT path, 'import', 'os', CAST(pos + 2 AS INT), CAST(pos + 2 AS INT), NULL, {tail}, fn, FALSE FROM step WHERE text = 'import os'")
    rows.append(f"""SELECT path, 'variable', regexp_extract(text, '^(\\w+) = ', 1), CAST(pos + 2 AS INT), CAST(pos + 2 AS INT),
  nullif(regexp_extract(text, '^\\w+ = "([^"]*)"$', 1), ''), {tail}, fn, FALSE FROM step WHERE regexp_matches(text, '^\\w+ = ')""")
    for name, off in (("answer", 3), ("page", 4)):
        rows.append(f"SELECT path, 'variable', '{name}', CAST(pos + {off} AS INT), CAST(pos + {off} AS INT), NULL, {tail}, fn, FALSE FROM step WHERE plain")
    return f"{_modules_cte()},\nsymbols AS (\n" + "\nUNION ALL\n".join(rows) + ")"


def sql_symbols_files():
    return f"WITH {_module_symbols_sql()}\nSELECT * FROM symbols"


def q_context_counts_files(spark, sf_dir):
    return SY.context_counts(_module_symbols(spark, sf_dir))


def sql_context_counts_files():
    return f"""WITH {_module_symbols_sql()}
SELECT path, count(*) FILTER (WHERE kind = 'import') AS n_imports, count(*) FILTER (WHERE kind = 'function') AS n_functions,
       count(*) FILTER (WHERE kind = 'class') AS n_classs, count(*) FILTER (WHERE kind = 'variable') AS n_variables FROM symbols GROUP BY path"""


def q_complexity_files(spark, sf_dir):
    files = C.syn_modules(spark, sf_dir)
    return SY.complexity(files, SY.symbol_table(files))


def sql_complexity_files():
    return f"WITH {_modules_cte()}\nSELECT path, CAST(n_lines + 3 AS BIGINT) AS complexity FROM mod"


def q_input_checks_files(spark, sf_dir):
    """K5 over whole files: ``input(...)`` and ``.get`` on a plain name."""
    calls = SY.calls_named(C.syn_modules(spark, sf_dir), CAT.INPUT_CALL_NAMES, CAT.HTTP_ATTRIBUTE_CALLS)
    return K.input_validation(calls).select("path", "check", "matched", "line_no")


def sql_input_checks_files():
    return f"""WITH {_modules_cte()}
SELECT path, 'input_validation' AS "check", m AS matched, CAST(pos + o AS INT) AS line_no
FROM step, (VALUES ('input', 3), ('session.get', 4)) v(m, o) WHERE plain"""


LCS_SQL = """list_reduce(range(1, length({a}) + 1),
   lambda prev, i: list_reduce(range(1, length({b}) + 1),
       lambda row, j: list_append(row, CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN prev[j] + 1
                                            ELSE greatest(prev[j + 1], row[-1]) END),
       [0]),
   list_transform(range(0, length({b}) + 1), lambda k: 0))[-1]"""


def sql_similar_calls():
    """D8 oracle: regex hits (rule P) or, failing the regex, LCS similarity
    >= 0.7 by a dynamic programme over nested ``list_reduce``."""
    rows = [(s, n, sev, i, p, len(p)) for s, n, sev, _d, pats in _cwe_catalog() for i, p in enumerate(pats)]
    pats = values(rows, ["sig_id", "name", "severity", "pattern_ord", "pattern", "plen"])
    lcs = LCS_SQL.format(a="text", b="pattern")
    return f"""WITH {_calls_cte()},
pairs AS (SELECT c.path, c.lineno, c.full_call_similar AS text, p.*,
                 regexp_matches(c.full_call_similar, '(?i)' || p.pattern) AS hit
          FROM calls c CROSS JOIN {pats} p),
sims AS (SELECT text, pattern, {lcs} / greatest(length(text), length(pattern)) AS sim
         FROM (SELECT DISTINCT text, pattern FROM pairs WHERE NOT hit
               AND least(length(text), length(pattern)) >= 0.7 * greatest(length(text), length(pattern))))
SELECT path, lineno, sig_id, name, severity, pattern_ord, text AS matched_code,
       round({conf_sql('text', 'plen', 'P')}, 6) AS confidence FROM pairs WHERE hit
UNION ALL
SELECT p.path, p.lineno, p.sig_id, p.name, p.severity, p.pattern_ord, p.text, round(s.sim, 6)
FROM pairs p JOIN sims s ON s.text = p.text AND s.pattern = p.pattern WHERE NOT p.hit AND s.sim >= 0.7"""


def q_similar_names(spark, sf_dir):
    """D8 + J14, Go form: call names against every pattern's text."""
    m = SY.match_similar_names(_calls(spark, sf_dir), CAT.PYTHON_CATALOG, 0.7)
    return m.withColumn("confidence", F.round("confidence", 6))


def sql_similar_names():
    rows = [(s, n, sev, i, p) for s, n, sev, _d, pats in CAT.PYTHON_CATALOG for i, p in enumerate(pats)]
    pats = values(rows, ["sig_id", "name", "severity", "pattern_ord", "pattern"])
    lcs = LCS_SQL.format(a="text", b="pattern")
    return f"""WITH {_calls_cte()},
pats AS {pats},
sims AS (SELECT text, pattern, {lcs} / greatest(length(text), length(pattern)) AS sim
         FROM (SELECT DISTINCT func_name AS text, pattern FROM calls CROSS JOIN pats
               WHERE least(length(func_name), length(pattern)) >= 0.7 * greatest(length(func_name), length(pattern))))
SELECT path, lineno, sig_id, name, severity, pattern_ord, func_name AS matched_code, round(sim, 6) AS confidence
FROM calls JOIN sims ON text = func_name JOIN pats USING (pattern) WHERE sim >= 0.7"""


# --- C1, K5 and K6 for Go: calls in masked code ------------------------------------------

def q_go_call_sites(spark, sf_dir):
    return SY.call_sites_regex(C.syn_go_files(spark, sf_dir))


_GO_CALLS = """(VALUES (0, 4, 'go_on'), (1, 3, 'fmt.Scanln'), (3, 3, 'exec.Command'), (3, 3, 'os.Getenv')) v(k, o, f)"""


def _go_calls_cte() -> str:
    return f"""{C.oracle_files_sql()},
calls AS (SELECT regexp_replace(path, '\\.(py|js)$', '.go') AS path, CAST(2 * (n - 1) + o AS INT) AS lineno, f AS func_name
          FROM syn_files, range(1, n_lines + 1) r(n), {_GO_CALLS} WHERE n % 4 = k)"""


def sql_go_call_sites():
    return f"""WITH {_go_calls_cte()}
SELECT path, lineno, func_name, CASE WHEN contains(func_name, '.') THEN split_part(func_name, '.', 1) END AS base,
       CASE WHEN contains(func_name, '.') THEN split_part(func_name, '.', 2) END AS attr FROM calls"""


def q_go_call_checks(spark, sf_dir):
    """K5 and K6, Go forms."""
    calls = SY.call_sites_regex(C.syn_go_files(spark, sf_dir))
    return K.input_validation_go(calls).unionByName(K.sandbox_escape_go(calls)).select("path", "check", "matched", "line_no")


def sql_go_call_checks():
    return f"""WITH {_go_calls_cte()}
SELECT path, CASE WHEN func_name = 'fmt.Scanln' THEN 'input_validation' ELSE 'sandbox_escape' END AS "check", func_name AS matched, lineno AS line_no
FROM calls WHERE func_name <> 'go_on'"""


# --- X2: an extractor of a user's own for one more extension --------------------------------

def _note_symbols(path: str, content: str) -> list[tuple]:
    """Assignments of a file, as variables."""
    found = [(n, line.partition(" = ")) for n, line in enumerate(content.split("\n"), 1) if " = " in line]
    return [(path, "variable", name, n, value) for n, (name, _, value) in found]


def q_analyzer_symbols(spark, sf_dir):
    """Symbols of ``.note`` files by a registered extractor, beside those of
    Python modules by the built-in one."""
    SY.register_analyzer(".note", _note_symbols)
    notes = C.syn_files(spark, sf_dir).select(F.regexp_replace("path", r"\.(py|js)$", ".note").alias("path"), "content")
    out = SY.symbol_table(notes.unionByName(C.syn_modules(spark, sf_dir)))
    return out.groupBy(F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("ext"), "kind", "name", "value").agg(F.count(F.lit(1)).alias("n")) \
        .where("ext = '.note' or kind in ('class', 'import')")


def sql_analyzer_symbols():
    return f"""WITH {_module_symbols_sql()}
SELECT '.note' AS ext, 'variable' AS kind, split_part(text, ' = ', 1) AS name, substr(text, strpos(text, ' = ') + 3) AS value, count(*) AS n
FROM syn_lines WHERE contains(text, ' = ') GROUP BY ALL
UNION ALL SELECT '.py', kind, name, value, count(*) FROM symbols WHERE kind IN ('class', 'import') GROUP BY ALL"""
