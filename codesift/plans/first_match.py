"""Registered first-match / semantic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import semantic as SE
from ..operators import symbols as SY
from ..sources import catalog as CAT
from . import corpus as C
from .sqltext import all_matches_sql, values


def _cwe(spark):
    return CAT.cwe_signatures(spark)


def q_first_match_scan(spark, sf_dir):
    """D4 + J12 + T10: first match per (file, signature, pattern), MULTILINE,
    snippet of +-3 lines, base confidence 0.5."""
    m = D.detect_first(C.syn_files(spark, sf_dir), _cwe(spark), strict_ext=False)
    return m.select("sig_id", "pattern_ord", "path", "line_start", "line_end", "matched_code", "confidence")


def sql_first_match_scan():
    rows = []
    ext_lang = {e.lstrip("."): lang for e, lang in CAT.EXTENSION_LANGUAGE}
    for s in CAT.CWE_SIGNATURES["signatures"]:
        exts = [e for e, lang in ext_lang.items() if lang in s["affected_languages"]]
        for i, p in enumerate(s["code_patterns"]):
            for e in exts:
                rows.append((s["id"], i, "(?m)" + p, e))
    pats = values(rows, ["sig_id", "pattern_ord", "pattern", "ext"])
    files = "(SELECT path, content, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS fext FROM syn_files)"
    return f"""WITH {C.oracle_files_sql()},
fp AS (SELECT f.path, f.content, p.sig_id, p.pattern_ord, p.pattern FROM {files} f
       JOIN {pats} p ON p.ext = f.fext),
m AS (SELECT * FROM {all_matches_sql('(SELECT path, content FROM fp GROUP BY ALL)',
                                     '(SELECT DISTINCT pattern, sig_id, pattern_ord FROM ' + pats + ')',
                                     'sig_id, pattern_ord')} x WHERE i = 1),
j AS (SELECT m.*, string_split(f.content, chr(10)) AS ls FROM m
      JOIN fp f ON f.path = m.path AND f.sig_id = m.sig_id AND f.pattern_ord = m.pattern_ord)
SELECT sig_id, pattern_ord, path, line_start, line_end,
       array_to_string(ls[greatest(0, line_start - 4) + 1 : least(len(ls), line_end + 3)], chr(10)) AS matched_code,
       CAST(0.5 AS DOUBLE) AS confidence
FROM j"""


def q_first_match_fix_similarity(spark, sf_dir):
    """J15 on top of D4 (rows-only: difflib ratios have no SQL equivalent)."""
    sigs = _cwe(spark)
    m = D.detect_first(C.syn_files(spark, sf_dir), sigs, strict_ext=False)
    return SE.fix_similarity(m, sigs).select(
        "sig_id", "pattern_ord", "path", "line_start", F.round("confidence", 6).alias("confidence"))


def q_first_match_context(spark, sf_dir):
    """Symbols of each match's file attached (counts of imports and
    variables; 0 for files without symbols or that do not parse)."""
    from pyspark import StorageLevel
    files = C.syn_files(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)  # read by two branches
    m = D.detect_first(files, _cwe(spark), strict_ext=False)
    ctx = SY.attach_context(m.select("sig_id", "pattern_ord", "path", "line_start"), SY.symbol_table(files))
    n = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c))
    return ctx.select("sig_id", "pattern_ord", "path", "line_start",
                      n("imports").alias("n_imports"), n("variables").alias("n_variables"))


def sql_first_match_context():
    """In this corpus a ``.py`` file parses unless it has an ``except:`` line, and
    other files have no symbols; its imports are its ``import x`` lines, its variables its
    ``name = ...`` lines."""
    fm = sql_first_match_scan()
    return f"""WITH fm AS ({fm}),
{C.oracle_files_sql()},
fc AS (SELECT path, list_contains(lines, 'except:') OR NOT ends_with(path, '.py') AS bad,
              len(list_filter(lines, lambda l: regexp_matches(l, '^import [A-Za-z_][A-Za-z0-9_]*$'))) AS ni,
              len(list_filter(lines, lambda l: regexp_matches(l, '^[A-Za-z_][A-Za-z0-9_]* = '))) AS nv
       FROM syn_files)
SELECT fm.sig_id, fm.pattern_ord, fm.path, fm.line_start,
       CAST(CASE WHEN fc.bad THEN 0 ELSE fc.ni END AS INT) AS n_imports,
       CAST(CASE WHEN fc.bad THEN 0 ELSE fc.nv END AS INT) AS n_variables
FROM fm JOIN fc ON fc.path = fm.path"""


def q_semantic_hashes(spark, sf_dir):
    """T8 over every synthetic file."""
    return SE.semantic_hashes(C.syn_files(spark, sf_dir)).select("path", "semantic_hash")


def sql_semantic_hashes():
    ident = r"\b[a-zA-Z_]\w*\b"
    return f"""WITH {C.oracle_files_sql()},
s1 AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(content, '(?m)#.*$', '', 'g'),
         '(?m)//.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') AS c FROM syn_files),
s2 AS (SELECT path, regexp_replace(regexp_replace(trim(regexp_replace(c, '\\s+', ' ', 'g')),
         '"[^"]*"', '""', 'g'), '''[^'']*''', '''''', 'g') AS c FROM s1),
s3 AS (SELECT path, c, regexp_extract_all(c, '{ident}') AS ids, string_split_regex(c, '{ident}') AS gaps FROM s2),
s4 AS (SELECT path, ids, gaps, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS uniq FROM s3)
SELECT path, sha256(array_to_string(list_transform(ids, lambda t, i: gaps[i] || 'var' ||
         CAST(list_position(uniq, t) - 1 AS VARCHAR)), '') || gaps[len(gaps)]) AS semantic_hash
FROM s4"""


def q_semantic_clone_groups(spark, sf_dir):
    """Files sharing one semantic hash (renamed / reformatted copies)."""
    h = SE.semantic_hashes(C.syn_files(spark, sf_dir))
    return h.groupBy("semantic_hash").agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") > 1)


def sql_semantic_clone_groups():
    return f"""WITH h AS ({sql_semantic_hashes().replace('WITH ', 'WITH ', 1)})
SELECT semantic_hash, count(*) AS n_files FROM h GROUP BY 1 HAVING count(*) > 1"""
