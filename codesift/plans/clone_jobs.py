"""Registered clone-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import clones as CL
from ..operators import report as R
from ..session import materialize
from . import corpus as C
from . import store as ST

THETA = 0.5


def _functions(spark, sf_dir):
    return C.syn_functions(spark, sf_dir)


def _with_fn_store() -> str:
    return f"WITH {C.oracle_files_sql()},\n{ST.oracle_functions_sql()},\n{ST.oracle_store_sql()}"


N = "lower(replace(replace(replace({x}, chr(13), ''), chr(9), ''), ' ', ''))"


def _n(x: str) -> str:
    return N.format(x=x)


# --- T1-T6: function forms -------------------------------------------------------------

def q_function_forms(spark, sf_dir):
    f = _functions(spark, sf_dir)
    return f.select("func_id", "name", "path", "dir", F.array_join("norm", "\n").alias("norm_text"),
                    F.array_join("abst", "\n").alias("abst_text"), "norm_hash")


def sql_function_forms():
    return f"""WITH {C.oracle_files_sql()},\n{ST.oracle_functions_sql()}
SELECT func_id, name, path, dir, array_to_string(norm, chr(10)) AS norm_text,
       array_to_string(abst, chr(10)) AS abst_text, norm_hash FROM syn_functions"""


def q_exact_clone_groups(spark, sf_dir):
    """T6 + grouping: functions sharing a normalised hash (exact clones)."""
    f = _functions(spark, sf_dir)
    return f.groupBy("norm_hash").agg(F.count(F.lit(1)).alias("n_functions"),
                                      F.countDistinct("dir").alias("n_dirs")).where(F.col("n_functions") > 1)


def sql_exact_clone_groups():
    return f"""WITH {C.oracle_files_sql()},\n{ST.oracle_functions_sql()}
SELECT norm_hash, count(*) AS n_functions, count(DISTINCT dir) AS n_dirs FROM syn_functions
GROUP BY 1 HAVING count(*) > 1"""


def q_document_line_hashes(spark, sf_dir):
    """T1/T2/T6 on real text: normalised-document hashes and how many
    documents share each (exact duplicates after normalisation)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = d.select("doc_id", F.md5(TX.normalize_for_hash("text")).alias("h"))
    return h.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def sql_document_line_hashes():
    return """SELECT md5(lower(translate(text, chr(10) || chr(13) || chr(9) || '{} ', ''))) AS h,
       count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1"""


# --- J1 / J2 / J3 -------------------------------------------------------------------

def q_clone_hash_hits(spark, sf_dir):
    st = ST.build_store(spark, sf_dir)
    return CL.hash_matches(_functions(spark, sf_dir), st["vuln_hash"], st["oss_idx"]).select(
        "func_id", "oss", "norm_hash")


def _hits_sql() -> str:
    return """hits AS (SELECT f.func_id, f.dir, h.oss, f.norm_hash FROM syn_functions f
  JOIN (SELECT DISTINCT oss, hash FROM vuln_hash WHERE oss IN (SELECT oss FROM oss_idx)) h ON f.norm_hash = h.hash)"""


def sql_clone_hash_hits():
    return _with_fn_store() + ",\n" + _hits_sql() + "\nSELECT func_id, oss, norm_hash FROM hits"


def q_clone_reused_vulns(spark, sf_dir):
    st = ST.build_store(spark, sf_dir)
    hits = CL.hash_matches(_functions(spark, sf_dir), st["vuln_hash"], st["oss_idx"])
    return CL.reused_vulns(hits, st["oss_idx"])


def sql_clone_reused_vulns():
    return _with_fn_store() + ",\n" + _hits_sql() + \
        "\nSELECT DISTINCT vuln_idx FROM oss_idx WHERE oss IN (SELECT oss FROM hits)"


def q_clone_reduced_functions(spark, sf_dir):
    st = ST.build_store(spark, sf_dir)
    f = _functions(spark, sf_dir)
    hits = CL.hash_matches(f, st["vuln_hash"], st["oss_idx"])
    return CL.reduce_by_dir(f, hits).select("func_id", "dir")


def sql_clone_reduced_functions():
    return _with_fn_store() + ",\n" + _hits_sql() + \
        "\nSELECT func_id, dir FROM syn_functions WHERE dir IN (SELECT dir FROM hits)"


# --- J8 / J9 ------------------------------------------------------------------------

def _bodies(st):
    b = st["vuln_body"]
    return b.select("vuln_idx", F.lit("vul").alias("which"), F.col("vul_body").alias("body")).unionByName(
        b.select("vuln_idx", F.lit("old").alias("which"), F.col("old_body").alias("body")))


def q_clone_containment(spark, sf_dir):
    st = ST.build_store(spark, sf_dir)
    p = CL.containment_pairs(_functions(spark, sf_dir), _bodies(st), THETA, min_lines=4)
    return p.select("func_id", "vuln_idx", "which", "shared", "size_v",
                    F.round("containment", 6).alias("containment"))


def sql_clone_containment():
    return _with_fn_store() + """,
bodies AS (SELECT vuln_idx, 'vul' AS which, list_distinct(vul_body) AS b FROM vuln_body
           UNION ALL SELECT vuln_idx, 'old', list_distinct(old_body) FROM vuln_body),
p AS (SELECT f.func_id, s.vuln_idx, s.which, CAST(len(list_intersect(s.b, f.norm)) AS BIGINT) AS shared,
             len(s.b) AS size_v
      FROM syn_functions f JOIN bodies s ON len(s.b) >= 4)
SELECT func_id, vuln_idx, which, shared, size_v, round(shared / size_v, 6) AS containment
FROM p WHERE shared / size_v >= 0.5"""


def q_clone_jaccard(spark, sf_dir):
    """J9 (upstream denominator) between target functions and vulnerable bodies."""
    st = ST.build_store(spark, sf_dir)
    a = _functions(spark, sf_dir).select(F.col("func_id").alias("a_id"), F.col("norm").alias("lines"))
    b = st["vuln_body"].select(F.col("vuln_idx").alias("b_id"), F.col("vul_body").alias("lines"))
    return CL.jaccard_pairs(a, b, THETA).withColumn("jaccard", F.round("jaccard", 6))


def sql_clone_jaccard():
    return _with_fn_store() + """,
p AS (SELECT f.func_id AS a_id, b.vuln_idx AS b_id, CAST(len(list_intersect(f.norm, b.vul_body)) AS BIGINT) AS inter,
             len(list_distinct(f.norm)) AS na, len(b.vul_body) AS nb
      FROM syn_functions f JOIN vuln_body b ON len(list_intersect(f.norm, b.vul_body)) > 0)
SELECT a_id, b_id, inter, round(inter / (na + nb - inter), 6) AS jaccard FROM p
WHERE inter / (na + nb - inter) >= 0.5"""


SENTENCE_SPLIT = r"[.!?]\s+|\n"


def _sentences(col):
    """Sentence units of prose, T1-normalised, blanks dropped."""
    return F.filter(F.transform(F.split(col, SENTENCE_SPLIT, -1), lambda x: TX.normalize_line(x)),
                    lambda x: F.length(x) > 0)


def q_benchmark_containment(spark, sf_dir):
    """J8 on real text: documents holding at least half of a benchmark
    passage's normalised sentences (passages are pasted mid-line, so the
    unit is the sentence, not the line)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("func_id"), _sentences(F.col("text")).alias("norm"))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").cast("string").alias("vuln_idx"), F.lit("passage").alias("which"),
        _sentences(F.col("text")).alias("body"))
    p = CL.containment_pairs(docs, bench, THETA, min_lines=1)
    return p.select(F.col("func_id").alias("doc_id"), F.col("vuln_idx").alias("item_id"), "shared", "size_v",
                    F.round("containment", 6).alias("containment"))


def sql_benchmark_containment():
    n = _n("x")
    sent = f"list_filter(list_transform(string_split_regex(text, '{SENTENCE_SPLIT}'), lambda x: {n}), lambda x: length(x) > 0)"
    return f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {sent} AS norm FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_distinct({sent}) AS b FROM benchmark),
p AS (SELECT d.doc_id, b.item_id, CAST(len(list_intersect(b.b, d.norm)) AS BIGINT) AS shared, len(b.b) AS size_v
      FROM d JOIN b ON len(b.b) >= 1)
SELECT doc_id, item_id, shared, size_v, round(shared / size_v, 6) AS containment FROM p
WHERE shared / size_v >= 0.5"""


# --- U1 ----------------------------------------------------------------------------

def _store_lines(st):
    return st["vuln_body"].select(F.explode("vul_body").alias("line"))


def _corpus_lines(spark, sf_dir):
    return _functions(spark, sf_dir).select(F.explode("norm").alias("line"))


def q_store_corpus_line_intersect(spark, sf_dir):
    st = ST.build_store(spark, sf_dir)
    return R.line_intersect(_store_lines(st), _corpus_lines(spark, sf_dir))


def sql_store_corpus_line_intersect():
    return _with_fn_store() + """
SELECT DISTINCT line FROM (SELECT unnest(vul_body) AS line FROM vuln_body)
INTERSECT SELECT DISTINCT line FROM (SELECT unnest(norm) AS line FROM syn_functions)"""


def q_store_corpus_line_union(spark, sf_dir):
    st = ST.build_store(spark, sf_dir)
    return R.line_union(_store_lines(st), _corpus_lines(spark, sf_dir))


def sql_store_corpus_line_union():
    return _with_fn_store() + """
SELECT line FROM (SELECT unnest(vul_body) AS line FROM vuln_body)
UNION SELECT line FROM (SELECT unnest(norm) AS line FROM syn_functions)"""


# --- S8 + D1 + J13 ------------------------------------------------------------------

def q_vuln_store_rules(spark, sf_dir):
    """The per-vulnerability rule table D1 uses (mode, abstraction, sizes)."""
    r = CL.vuln_rules(ST.build_store(spark, sf_dir))
    return r.select("vuln_idx", "flag", "is_abs", *[F.size(c).alias(f"n_{c}") for c in (
        "core_norm", "core_abs", "new_pat", "new_abs_pat", "dep_vul_abs", "dep_old_abs", "vul_set", "old_set")])


def _rules_sql() -> str:
    t3 = ST.T3_RE2.replace("'", "''")
    sl = lambda c: f"list_distinct(list({c}))"
    return f"""hc AS (SELECT DISTINCT vuln_idx FROM ess_lines WHERE kind = 'common'),
ess AS (SELECT vuln_idx, {sl(_n('vul_body'))} AS core_norm, {sl(_n('abs_body'))} AS core_abs FROM ess_lines
        WHERE kind = 'common' OR vuln_idx NOT IN (SELECT vuln_idx FROM hc) GROUP BY 1),
pat AS (SELECT p.vuln_idx, {sl(_n('p.abs_body'))} AS pat_abs_all,
   coalesce(list_distinct(list({_n('p.pat_body')}) FILTER (WHERE NOT coalesce(list_contains(b.vul_body, {_n('p.pat_body')}), false)
        AND {_n('p.pat_body')} NOT IN ('', '{{', '}}'))), []::VARCHAR[]) AS new_pat,
   coalesce(list_distinct(list({_n('p.abs_body')}) FILTER (WHERE NOT coalesce(list_contains(b.vul_body, {_n('p.pat_body')}), false)
        AND {_n('p.abs_body')} NOT IN ('', '{{', '}}'))), []::VARCHAR[]) AS new_abs_pat
   FROM pat_lines p LEFT JOIN vuln_body b ON b.vuln_idx = p.vuln_idx GROUP BY 1),
dep AS (SELECT vuln_idx,
   coalesce(list_distinct(list(regexp_replace(abs_norm_vul, '{t3}', '\\3', 'g')) FILTER (WHERE origin = 'vul')), []::VARCHAR[]) AS dep_vul_abs,
   coalesce(list_distinct(list(regexp_replace(orig_norm_vul, '{t3}', '\\3', 'g')) FILTER (WHERE origin = 'vul')), []::VARCHAR[]) AS dep_vul_nor,
   coalesce(list_distinct(list(regexp_replace(abs_norm_vul, '{t3}', '\\3', 'g')) FILTER (WHERE origin = 'old')), []::VARCHAR[]) AS dep_old_abs,
   coalesce(list_distinct(list(regexp_replace(orig_norm_vul, '{t3}', '\\3', 'g')) FILTER (WHERE origin = 'old')), []::VARCHAR[]) AS dep_old_nor
   FROM dep_lines GROUP BY 1),
rules AS (SELECT b.vuln_idx,
   CASE WHEN p.vuln_idx IS NOT NULL AND coalesce(len(e.core_norm), 0) = 0 THEN 3
        WHEN p.vuln_idx IS NOT NULL THEN 2 WHEN coalesce(len(e.core_norm), 0) > 0 THEN 1 ELSE 0 END AS flag,
   CASE WHEN p.vuln_idx IS NOT NULL AND coalesce(len(e.core_norm), 0) > 0
        THEN NOT coalesce(list_sort(p.pat_abs_all) = list_sort(e.core_abs), false) ELSE true END AS is_abs,
   coalesce(e.core_norm, []::VARCHAR[]) AS core_norm, coalesce(e.core_abs, []::VARCHAR[]) AS core_abs,
   coalesce(p.new_pat, []::VARCHAR[]) AS new_pat, coalesce(p.new_abs_pat, []::VARCHAR[]) AS new_abs_pat,
   coalesce(d.dep_vul_abs, []::VARCHAR[]) AS dep_vul_abs, coalesce(d.dep_vul_nor, []::VARCHAR[]) AS dep_vul_nor,
   coalesce(d.dep_old_abs, []::VARCHAR[]) AS dep_old_abs, coalesce(d.dep_old_nor, []::VARCHAR[]) AS dep_old_nor,
   list_distinct(coalesce(b.vul_body, []::VARCHAR[])) AS vul_set, list_distinct(coalesce(b.old_body, []::VARCHAR[])) AS old_set
  FROM vuln_body b LEFT JOIN ess e ON e.vuln_idx = b.vuln_idx LEFT JOIN pat p ON p.vuln_idx = b.vuln_idx
  LEFT JOIN dep d ON d.vuln_idx = b.vuln_idx)"""


def sql_vuln_store_rules():
    cols = ", ".join(f"CAST(len({c}) AS INT) AS n_{c}" for c in (
        "core_norm", "core_abs", "new_pat", "new_abs_pat", "dep_vul_abs", "dep_old_abs", "vul_set", "old_set"))
    return _with_fn_store() + ",\n" + _rules_sql() + f"\nSELECT vuln_idx, flag, is_abs, {cols} FROM rules WHERE flag > 0"


def q_clone_findings(spark, sf_dir):
    """D1 end to end.  The detector reads the target functions three times
    (hash hits, candidate pairs, names); here they are derived from lineitem,
    so they are written once and scanned with column pruning, as the function
    store of a production run (``save_functions``) is."""
    functions = materialize(_functions(spark, sf_dir), "functions")
    return CL.detect_clones(functions, ST.build_store(spark, sf_dir), THETA)


def sql_clone_findings():
    return _with_fn_store() + ",\n" + _hits_sql() + ",\n" + _rules_sql() + """,
reused AS (SELECT DISTINCT vuln_idx FROM oss_idx WHERE oss IN (SELECT oss FROM hits)),
targets AS (SELECT * FROM syn_functions WHERE dir IN (SELECT dir FROM hits)),
pairs AS (
  SELECT r.*, t.func_id, t.name, t.path, list_distinct(t.norm) AS x, list_distinct(t.abst) AS y
  FROM rules r JOIN targets t ON true
  WHERE r.flag > 0 AND len(r.vul_set) > 3 AND r.vuln_idx IN (SELECT vuln_idx FROM reused)),
ev AS (
  SELECT *,
    len(list_intersect(vul_set, x)) / len(vul_set) >= 0.5 AS cv,
    len(old_set) > 0 AND len(list_intersect(old_set, x)) / len(old_set) >= 0.5 AS co,
    CASE WHEN flag = 3 THEN len(new_abs_pat) > 0 AND NOT list_has_any(new_abs_pat, y)
         WHEN is_abs THEN list_has_all(y, core_abs)
              AND (list_has_all(y, dep_vul_abs) OR (len(dep_old_abs) > 0 AND list_has_all(y, dep_old_abs)))
              AND (flag <> 2 OR NOT list_has_any(new_abs_pat, y))
         ELSE list_has_all(x, core_norm)
              AND (list_has_all(x, dep_vul_nor) OR (len(dep_old_nor) > 0 AND list_has_all(x, dep_old_nor)))
              AND (flag <> 2 OR NOT list_has_any(new_pat, x)) END AS ok
  FROM pairs)
SELECT ev.vuln_idx, c.cve, func_id, name, path, CASE WHEN cv THEN 'vul' ELSE 'old' END AS matched_on
FROM ev LEFT JOIN vuln_cve c ON c.vuln_idx = ev.vuln_idx WHERE ok AND (cv OR co)"""


def q_clone_rule_checks(spark, sf_dir):
    """J5 + J6 + J7 per candidate pair (before the final conjunction)."""
    functions = materialize(_functions(spark, sf_dir), "functions")
    r = CL.rule_checks(functions, ST.build_store(spark, sf_dir), THETA)
    return r.select("vuln_idx", "func_id", "flag", "is_abs", "vul_ok", "ess_ok", "dep_ok", "patch_ok")


def sql_clone_rule_checks():
    return _with_fn_store() + ",\n" + _hits_sql() + ",\n" + _rules_sql() + """,
reused AS (SELECT DISTINCT vuln_idx FROM oss_idx WHERE oss IN (SELECT oss FROM hits)),
targets AS (SELECT * FROM syn_functions WHERE dir IN (SELECT dir FROM hits)),
pairs AS (
  SELECT r.*, t.func_id, list_distinct(t.norm) AS x, list_distinct(t.abst) AS y
  FROM rules r JOIN targets t ON true
  WHERE r.flag > 0 AND len(r.vul_set) > 3 AND r.vuln_idx IN (SELECT vuln_idx FROM reused)),
ev AS (
  SELECT *,
    len(list_intersect(vul_set, x)) / len(vul_set) >= 0.5 AS cv,
    len(old_set) > 0 AND len(list_intersect(old_set, x)) / len(old_set) >= 0.5 AS co
  FROM pairs)
SELECT vuln_idx, func_id, flag, is_abs, cv AS vul_ok,
  CASE WHEN flag = 3 THEN true WHEN is_abs THEN list_has_all(y, core_abs) ELSE list_has_all(x, core_norm) END AS ess_ok,
  CASE WHEN flag = 3 THEN true
       WHEN is_abs THEN list_has_all(y, dep_vul_abs) OR (len(dep_old_abs) > 0 AND list_has_all(y, dep_old_abs))
       ELSE list_has_all(x, dep_vul_nor) OR (len(dep_old_nor) > 0 AND list_has_all(x, dep_old_nor)) END AS dep_ok,
  CASE WHEN flag = 3 THEN len(new_abs_pat) > 0 AND NOT list_has_any(new_abs_pat, y)
       WHEN flag = 2 THEN (CASE WHEN is_abs THEN NOT list_has_any(new_abs_pat, y) ELSE NOT list_has_any(new_pat, x) END)
       ELSE true END AS patch_ok
FROM ev WHERE cv OR co"""


def q_text_forms_lines(spark, sf_dir):
    """T1 / T2 / T3 per corpus line (whole lines, every line)."""
    lines = C.syn_lines(spark, sf_dir)
    return lines.select("path", "line_no", TX.normalize_line("text").alias("t1"),
                        TX.normalize_for_hash("text").alias("t2"), TX.strip_comments("text").alias("t3"))


def sql_text_forms_lines():
    t3 = ST.T3_RE2.replace("'", "''")
    return f"""WITH {C.oracle_lines_sql()}
SELECT path, line_no, {_n('text')} AS t1,
       lower(translate(text, chr(10) || chr(13) || chr(9) || '{{}} ', '')) AS t2,
       regexp_replace(text, '{t3}', '\\3', 'g') AS t3
FROM syn_lines"""


def q_brace_functions(spark, sf_dir):
    """T7 without tags over the C view of the corpus, whose statements hold
    braces in strings, characters and comments besides real blocks."""
    return CL.extract_functions_braces(C.syn_braced_files(spark, sf_dir)).select("path", "name", "start_line", "end_line")


def sql_brace_functions():
    return f"""WITH {C.oracle_files_sql()}
SELECT regexp_replace(path, '\\.(py|js)$', '.c') AS path, unnest(['f', 'g']) || CAST(file_id AS VARCHAR) AS name,
       unnest([4, n_lines + 9]) AS start_line, unnest([n_lines + 7, n_lines + 9]) AS end_line
FROM syn_files"""


def q_clone_findings_by_cve(spark, sf_dir):
    """Rollup over D1: affected functions and files per CVE (partial
    aggregation, one small shuffle)."""
    f = q_clone_findings(spark, sf_dir)
    return f.groupBy("vuln_idx", "cve").agg(F.count(F.lit(1)).alias("n_functions"),
                                            F.countDistinct("path").alias("n_files"),
                                            F.count_if(F.col("matched_on") == "old").alias("n_via_old_body"))


def sql_clone_findings_by_cve():
    return f"""WITH d AS ({sql_clone_findings()})
SELECT vuln_idx, cve, count(*) AS n_functions, count(DISTINCT path) AS n_files,
       count(*) FILTER (WHERE matched_on = 'old') AS n_via_old_body
FROM d GROUP BY 1, 2"""


def q_clone_findings_c(spark, sf_dir):
    """Job A on the C view of the corpus: functions by brace depth (no tags),
    three forms, the per-nation store built the same way, D1."""
    functions = materialize(C.syn_c_functions(spark, sf_dir), "functions")
    return CL.detect_clones(functions, ST.build_store(spark, sf_dir, c_view=True), THETA)


def sql_clone_findings_c():
    base = f"WITH {C.oracle_files_sql()},\n{C.oracle_c_files_sql()},\n{ST.oracle_functions_sql('syn_cfuncs')},\n" \
           f"{ST.oracle_store_sql()}"
    body = sql_clone_findings()
    return base + body[body.index(",\nhits AS"):]


# --- T4 with parameters, types and locals --------------------------------------------------------

T4_PARAMS, T4_TYPES = ["src", "blob", "b", "args"], ["unsigned int", "char", "int"]


def q_abstract_forms(spark, sf_dir):
    """T4 on the C view with a declaration line: parameters, data types (one of
    two words) and the assigned names as locals; a word that follows itself is
    in every body."""
    files = C.syn_c_files(spark, sf_dir)
    body = F.replace("content", F.lit("{\n"), F.lit("{\n    unsigned int total; int x, b b;\n"))
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    fn = files.select("path", body.alias("body")).withColumn("locals", C.assigned_names(F.col("body")))
    return fn.select("path", CL.abstract_identifiers(F.col("body"), lits(T4_PARAMS), lits(T4_TYPES), F.col("locals")).alias("abst_body"),
                     CL.abstract_identifiers(F.regexp_replace("body", "b b;", "b;"), locals_=F.col("locals")).alias("abst_locals"))


def sql_abstract_forms():
    one = lambda s, i, t: f"regexp_replace({s}, '(^|\\W)' || {i} || '(\\W)', '\\1{t}\\2', 'g')"
    s = "body"
    for ids, token in ((T4_PARAMS, "FPARAM"), (T4_TYPES, "DTYPE")):
        for i in ids:
            s = one(s, f"'{i}'", token)
    loc = lambda s: f"list_reduce(locals, lambda s, v: {one('s', 'v', 'LVAR')}, {s})"
    names = r"regexp_extract_all(body, '(?m)^\s*([A-Za-z_]\w*)\s*=[^=]', 1)"
    return f"""WITH {C.oracle_files_sql()},\n{C.oracle_c_files_sql()},
b AS (SELECT path, replace(content || chr(10), '{{' || chr(10), '{{' || chr(10) || '    unsigned int total; int x, b b;' || chr(10)) AS body FROM syn_cfuncs),
f AS (SELECT path, body, list_filter({names}, lambda x, i: list_position({names}, x) = i) AS locals FROM b)
SELECT path, {loc(s)} AS abst_body, {loc("replace(body, 'b b;', 'b;')")} AS abst_locals FROM f"""
