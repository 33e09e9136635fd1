"""Registered lifecycle queries: sources, sinks, incremental and streaming
scans (S1-S4, S8, S9, S10, S11-S13, T7, J10, I1, I2, X1).

Each writes its intermediate files under a fresh folder inside the shared
checkpoint folder (``spark.checkpoint.dir``), reads them back with Spark and
returns the reloaded table; the oracle is the SQL of the source table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clones as CL
from ..operators import detect as D
from ..operators import registry as REG
from ..session import ensure_checkpoint_dir, materialize
from ..sources import files as SF
from ..sources import sinks as SK
from ..sources import vulnstore as VS
from ..streaming import scan as STR
from . import clone_jobs as CJ
from . import corpus as C
from . import scans as S
from . import store as ST
from .sqltext import q


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- S1 / S4 ---------------------------------------------------------------------------

def q_corpus_files(spark, sf_dir):
    """S1 over the driver's own table files, of any size (rows-only: the
    oracle has no file access)."""
    f = SF.scan_corpus(spark, sf_dir, max_bytes=None, decode=False, content=False)
    return f.select("path", "ext", "size", "sha256")


# --- S2 / S3 ---------------------------------------------------------------------------

def q_resolve_language(spark, sf_dir):
    return SF.resolve_language(C.syn_files(spark, sf_dir)).select("path", "ext", "language")


def sql_resolve_language():
    cases = " ".join(f"WHEN {q(e)} THEN {q(lang)}" for e, lang in SF.CAT.EXTENSION_LANGUAGE)
    return f"""WITH {C.oracle_files_sql()}
SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext,
       CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) {cases} END AS language FROM syn_files"""


BASENAME_GLOBS = ["m1*", "*.js", "f1??.py"]
PATH_GLOBS = ["**/m2/*", "src/m3?/*.py", "f4*.js"]


def q_exclude_globs_basename(spark, sf_dir):
    return SF.exclude_globs(C.syn_files(spark, sf_dir), BASENAME_GLOBS, "basename").select("path")


def sql_exclude_globs_basename():
    cond = " OR ".join(
        f"list_bool_or(list_transform(string_split(path, '/'), lambda s: regexp_matches(s, {q(SF.glob_regex(g))})))"
        for g in BASENAME_GLOBS)
    return f"WITH {C.oracle_files_sql()}\nSELECT path FROM syn_files WHERE NOT ({cond})"


def q_exclude_globs_path(spark, sf_dir):
    return SF.exclude_globs(C.syn_files(spark, sf_dir), PATH_GLOBS, "path").select("path")


def sql_exclude_globs_path():
    cond = " OR ".join(f"regexp_matches(path, {q(SF.glob_regex(g, 'path'))})" for g in PATH_GLOBS)
    return f"WITH {C.oracle_files_sql()}\nSELECT path FROM syn_files WHERE NOT ({cond})"


# --- S10 -------------------------------------------------------------------------------

def _code_rows(spark, sf_dir):
    """Inline code rows: every synthetic line (language from its extension;
    assignment lines carry their file name, the others get the default) and
    every document (language = its natural language, unsupported)."""
    lines = C.syn_lines(spark, sf_dir).select(
        F.col("text").alias("code"),
        F.when(F.col("path").endswith(".py"), "python").otherwise("javascript").alias("language"),
        F.when(F.col("text").contains("="), F.col("path")).alias("fileName"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("text").alias("code"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("fileName"))
    return lines.unionByName(docs)


def q_inline_batch_accepted(spark, sf_dir):
    ok, _bad = SF.inline_batch(_code_rows(spark, sf_dir))
    return ok.groupBy("path", "language").agg(F.count(F.lit(1)).alias("n"))


def _code_rows_sql() -> str:
    return f"""{C.oracle_lines_sql()},
rows AS (
  SELECT text AS code, CASE WHEN ends_with(path, '.py') THEN 'python' ELSE 'javascript' END AS language,
         CASE WHEN contains(text, '=') THEN path END AS fileName FROM syn_lines
  UNION ALL SELECT text, lang, NULL FROM documents),
named AS (SELECT code, language, coalesce(CASE WHEN fileName <> '' THEN fileName END, 'code.' || language) AS path
          FROM rows)"""


def _supported_sql() -> str:
    langs = [lang for d in SF.CAT.DETECTOR_LANGUAGES.values() for lang in d]
    return ", ".join(q(x) for x in langs)


def sql_inline_batch_accepted():
    return f"""WITH {_code_rows_sql()}
SELECT path, language, count(*) AS n FROM named WHERE language IN ({_supported_sql()}) GROUP BY 1, 2"""


def q_inline_batch_rejected(spark, sf_dir):
    _ok, bad = SF.inline_batch(_code_rows(spark, sf_dir))
    return bad.groupBy("path", "language", "error").agg(F.count(F.lit(1)).alias("n"))


def sql_inline_batch_rejected():
    return f"""WITH {_code_rows_sql()}
SELECT path, language, 'Unsupported language: ' || language AS error, count(*) AS n FROM named
WHERE language NOT IN ({_supported_sql()}) GROUP BY 1, 2, 3"""


# --- S11 / S12 ---------------------------------------------------------------------------

def q_json_report(spark, sf_dir):
    """Write the report folder, read the per-file documents back."""
    out = _scratch(spark, "report-json")
    SK.write_json(S.go_scan(spark, sf_dir), out, timestamp="1970-01-01T00:00:00Z",
                  signatures=S._catalog_signatures(spark))
    r = SK.read_json_report(spark, out)
    m = r.select(F.col("path").alias("file"), F.col("n").cast("bigint").alias("n"), F.explode("matches").alias("m"))
    return m.select("file", "n", F.col("m.sig_id").alias("id"), "m.name", "m.description", "m.severity",
                    F.col("m.line_start").cast("int").alias("line_start"),
                    F.col("m.line_end").cast("int").alias("line_end"), "m.matched_code",
                    F.round("m.confidence", 6).alias("confidence"))


def sql_json_report():
    return f"""SELECT file, count(*) OVER (PARTITION BY file) AS n, id, name, description, severity, line_start,
       line_end, matched_code, confidence FROM ({S.sql_report_rows()})"""


def q_xml_report(spark, sf_dir):
    """XML report folder read back with the XML source."""
    out = _scratch(spark, "report-xml")
    SK.write_xml(S.go_scan(spark, sf_dir), out, timestamp="1970-01-01T00:00:00Z",
                 signatures=S._catalog_signatures(spark))
    r = SK.read_xml_report(spark, out)
    m = r.select(F.col("_path").alias("file"), F.explode("match").alias("m"))
    return m.select("file", F.col("m._id").alias("id"), "m.name", "m.description", "m.severity",
                    F.col("m.lineNumber").alias("line_start"), F.round("m.confidence", 6).alias("confidence"))


def sql_xml_report():
    return f"SELECT file, id, name, description, severity, line_start, confidence FROM ({S.sql_report_rows()})"


# --- S13 ---------------------------------------------------------------------------------

def q_function_store(spark, sf_dir):
    out = _scratch(spark, "functions")
    fn = C.syn_functions(spark, sf_dir).withColumn("repo", F.regexp_extract("path", r"^src/([^/]*)/", 1))
    SK.save_functions(fn, out)
    return SK.load_functions(spark, out).select("func_id", "repo", "norm_hash")


def sql_function_store():
    return f"""WITH {C.oracle_files_sql()},\n{ST.oracle_functions_sql()}
SELECT func_id, regexp_extract(path, '^src/([^/]*)/', 1) AS repo, norm_hash FROM syn_functions"""


# --- S8: store written in the on-disk layout and reloaded, then D1 ---------------------------

def q_vuln_store_files(spark, sf_dir):
    root = _scratch(spark, "vulnstore")
    VS.write_vuln_store(ST.build_store(spark, sf_dir), root)
    functions = materialize(C.syn_functions(spark, sf_dir), "functions")
    return CL.detect_clones(functions, VS.load_vuln_store(spark, root), CJ.THETA)


def sql_vuln_store_files():
    return CJ.sql_clone_findings()


# --- S9 + T7 + J10 + T4: functions from a ctags-style tag file -------------------------------

def _tag_file(spark, sf_dir) -> str:
    """Write a ctags TSV for the corpus: one function tag spanning each file,
    one ``local`` tag per assigned name (at its first assignment line, as a
    declaration)."""
    lines = C.syn_lines(spark, sf_dir)
    files = C.syn_files(spark, sf_dir)
    fn_tags = files.select(F.concat_ws(
        "\t", F.concat(F.lit("f"), F.col("file_id").cast("string")), "path", F.lit('/^x$/;"'), F.lit("function"),
        F.lit("line:1"), F.lit("typeref:typename:int"), F.lit("signature:()"),
        F.concat(F.lit("end:"), F.col("n_lines").cast("string"))).alias("value"))
    name = F.regexp_extract("text", r"^\s*([A-Za-z_]\w*)\s*=[^=]", 1)
    first = lines.where(name != "").groupBy("file_id", "path", name.alias("name")).agg(
        F.min("line_no").alias("line_no"))
    name = F.col("name")
    loc_tags = first.select(F.concat_ws(
        "\t", name, "path", F.lit('/^x$/;"'), F.lit("local"),
        F.concat(F.lit("line:"), F.col("line_no").cast("string")),
        F.concat(F.lit("function:f"), F.col("file_id").cast("string"))).alias("value"))
    out = _scratch(spark, "tags")
    fn_tags.unionByName(loc_tags).write.mode("overwrite").text(out)
    return out


def q_tag_functions(spark, sf_dir):
    tags = VS.load_tags(spark, _tag_file(spark, sf_dir))
    lines = C.syn_lines(spark, sf_dir)
    fns = CL.extract_functions(lines, tags)
    ids = CL.tags_in_functions(tags)
    j = fns.join(ids, ["path", "name", "start_line"], "left")
    forms = CL.three_forms(j.select("name", "path", "body", "params", "dtypes", "locals"),
                           params_col=F.col("params"), dtypes_col=F.col("dtypes"), locals_col=F.col("locals"))
    return forms.select("func_id", F.array_join("abst", "\n").alias("abst_text"), "norm_hash")


def sql_tag_functions():
    return f"""WITH {C.oracle_files_sql()},\n{ST.oracle_functions_sql()}
SELECT func_id, array_to_string(abst, chr(10)) AS abst_text, norm_hash FROM syn_functions"""


# --- I1: incremental = full ---------------------------------------------------------------------

def _go_detect(files):
    reg = REG.default_registry()
    return reg.run(files, 0.7)


def q_incremental_scan(spark, sf_dir):
    """A first pass with an empty state, then a second pass with the
    first pass's state; the second pass rescans nothing and returns the
    full result."""
    # read by the anti-join, the detectors and the semi-join
    files = materialize(C.syn_files(spark, sf_dir).select("path", F.sha2("content", 256).alias("sha256"), "content"),
                        "files")
    empty_files = STR.empty(spark, "path string, sha256 string")
    empty_res = STR.empty(spark, D.match_schema() + ", sha256 string")
    res1, state1, _fresh1 = STR.scan_incremental(files, empty_files, empty_res, _go_detect)
    state_dir = _scratch(spark, "incremental")
    res1.write.mode("overwrite").parquet(f"{state_dir}/results")
    state1.write.mode("overwrite").parquet(f"{state_dir}/files")
    res2, _state2, _fresh2 = STR.scan_incremental(
        files, spark.read.parquet(f"{state_dir}/files"), spark.read.parquet(f"{state_dir}/results"), _go_detect)
    return res2.select(*D.MATCH_COLUMNS).withColumn("confidence", F.round("confidence", 6))


def sql_incremental_scan():
    return S.sql_go_directory_scan()


# --- I2: streaming scan ---------------------------------------------------------------------------

def q_stream_scan(spark, sf_dir):
    """Corpus files land as parquet files in a folder; a Structured
    Streaming query (availableNow, one file per micro-batch) runs the Go
    detectors on each batch; the reloaded sink equals the batch scan."""
    src = _scratch(spark, "stream-src")
    C.syn_files(spark, sf_dir).select("path", "content").repartition(4).write.mode("overwrite").parquet(src)
    out, ckpt = _scratch(spark, "stream-out"), _scratch(spark, "stream-ckpt")
    query = STR.scan_stream(spark, src, _go_detect, out, ckpt, max_files_per_trigger=1)
    query.awaitTermination()
    return spark.read.parquet(out).select(*D.MATCH_COLUMNS).withColumn("confidence", F.round("confidence", 6))


def sql_stream_scan():
    return S.sql_go_directory_scan()


# --- I1: edited, added and removed files, versioned state --------------------------------------

def _edited(files):
    """The corpus as it is later: one-line files are gone, JavaScript files have
    one line more."""
    js = F.col("path").endswith(".js")
    return files.where("n_lines > 1").withColumn("content", F.when(js, F.concat("content", F.lit("\neval(late)"))).otherwise(F.col("content")))


def q_incremental_versions(spark, sf_dir):
    """Version 1 of a corpus without its seven-line files, then version 2
    with those added, JavaScript files edited and one-line files removed.  Its
    results, with the counts of its manifest row."""
    files = materialize(C.syn_files(spark, sf_dir).select("path", "content", "n_lines"), "corpus")  # read by both versions
    keyed = lambda df: materialize(df.select("path", F.sha2("content", 256).alias("sha256"), "content"), "files")
    scan = STR.IncrementalScan(spark, _scratch(spark, "versions"), D.match_schema())
    scan.update(keyed(files.where("n_lines < 7")), _go_detect)
    out = scan.update(keyed(_edited(files)), _go_detect)
    counts = scan.manifest().where("version = 2").first()
    return out.select(*D.MATCH_COLUMNS, *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("n_files", "n_scanned", "n_kept", "n_removed")]) \
        .withColumn("confidence", F.round("confidence", 6))


def sql_incremental_versions():
    base = C.oracle_files_sql().replace("syn_lines", "base_lines").replace("syn_files", "base_files")
    return f"""WITH {base},
syn_lines AS (
  SELECT b.* FROM base_lines b JOIN base_files f USING (path) WHERE n_lines > 1
  UNION ALL SELECT file_id, CAST(n_lines + 1 AS INT), path, 'eval(late)' FROM base_files WHERE n_lines > 1 AND path LIKE '%.js'),
syn_files AS (SELECT file_id, path, string_agg(text, chr(10) ORDER BY line_no) AS content FROM syn_lines GROUP BY file_id, path),
{S._go_scan_cte()},
counts AS (SELECT count(*) FILTER (WHERE n_lines > 1) AS n_files,
  count(*) FILTER (WHERE n_lines > 1 AND (path LIKE '%.js' OR n_lines >= 7)) AS n_scanned,
  count(*) FILTER (WHERE n_lines BETWEEN 2 AND 6 AND path NOT LIKE '%.js') AS n_kept,
  count(*) FILTER (WHERE n_lines = 1) AS n_removed FROM base_files)
SELECT scan.*, counts.* FROM scan, counts WHERE confidence >= 0.7"""


# --- I2: the same content streamed twice -----------------------------------------------------

def q_stream_distinct_scan(spark, sf_dir):
    """Every file's content arrives, then, after a restart of the stream
    from its checkpoint, all of it again under a later time; each content is
    scanned once.  Paths are made of the content's sha256."""
    src, out, ckpt = (_scratch(spark, f"stream-{x}") for x in ("twice", "once", "state"))
    files = C.syn_files(spark, sf_dir).select(F.concat(F.lit("c/"), F.sha2("content", 256), F.lit(".py")).alias("path"), "content")
    for minute in (0, 1):
        arrived = F.expr(f"timestamp'2024-01-01 00:0{minute}:00'").alias("arrived")
        files.select("path", "content", arrived).repartition(2).write.mode("append").parquet(src)
        STR.scan_stream(spark, src, _go_detect, out, ckpt, schema="path string, content string, arrived timestamp",
                        max_files_per_trigger=1, distinct_within="1 hour").awaitTermination()
    return spark.read.parquet(out).select(*D.MATCH_COLUMNS).withColumn("confidence", F.round("confidence", 6))


def sql_stream_distinct_scan():
    base = C.oracle_files_sql().replace("syn_lines", "base_lines").replace("syn_files", "base_files")
    return f"""WITH {base},
syn_files AS (SELECT DISTINCT 'c/' || sha256(content) || '.py' AS path, content FROM base_files),
syn_lines AS (SELECT path, CAST(i AS INT) AS line_no, string_split(content, chr(10))[i] AS text
              FROM syn_files, range(1, len(string_split(content, chr(10))) + 1) r(i)),
{S._go_scan_cte()}
SELECT * FROM scan WHERE confidence >= 0.7"""


# --- S1 / S4: files written in several encodings and read back ----------------------------------

def q_decoded_files(spark, sf_dir):
    """A folder of UTF-8, CP949, invalid and oversized files, one of
    each per nation, read back decoded with a size limit."""
    STR.use_cp949(spark)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name"))
    text = F.concat(F.lit("\ub098\ub77c "), "name", F.lit("\r\n"), "name", F.lit("\rend"))
    kinds = {"utf8": F.encode(text, "UTF-8"), "cp949": F.encode(text, "x-windows-949"),
             "broken": F.concat(F.encode("name", "UTF-8"), F.unhex(F.lit("FF81FF"))), "large": F.encode(F.repeat("name", 400), "UTF-8")}
    root = _scratch(spark, "encodings")
    # a string column of a file's bytes; the writer adds a line feed
    rows = n.select("k", F.explode(F.create_map(*[x for k, b in kinds.items() for x in (F.lit(k), b)])).alias("kind", "bytes"))
    rows.select("kind", "k", F.col("bytes").cast("string").alias("value")).repartition(4).write.option("maxRecordsPerFile", 1) \
        .partitionBy("kind", "k").text(root)
    files = SF.scan_corpus(spark, root, max_bytes=1000, suffixes=(".txt",))
    part = lambda c: F.regexp_extract("path", f"{c}=([^/]*)", 1)
    return files.select(part("kind").alias("kind"), part("k").cast("int").alias("k"), "size", "sha256", "content")


def sql_decoded_files():
    text = "'\ub098\ub77c ' || n_name || {a} || n_name || {b} || 'end'"
    raw, read = text.format(a="chr(13) || chr(10)", b="chr(13)"), text.format(a="chr(10)", b="chr(10)")
    cp949 = "unhex('B3AAB6F320') || encode(n_name) || unhex('0D0A') || encode(n_name) || unhex('0D') || encode('end') || unhex('0A')"
    broken = "encode(n_name) || unhex('FF81FF0A')"
    return f"""SELECT 'utf8' AS kind, CAST(n_nationkey AS INT) AS k, CAST(octet_length(encode({raw})) + 1 AS BIGINT) AS size,
  sha256(encode({raw}) || unhex('0A')) AS sha256, {read} || chr(10) AS content FROM nation
UNION ALL SELECT 'cp949', CAST(n_nationkey AS INT), CAST(octet_length({cp949}) AS BIGINT), sha256({cp949}), {read} || chr(10) FROM nation
UNION ALL SELECT 'broken', CAST(n_nationkey AS INT), CAST(octet_length({broken}) AS BIGINT), sha256({broken}), '' FROM nation"""


# --- A10: what the registered detectors support, over the corpus ---------------------------------

def q_supported_languages(spark, sf_dir):
    """A10: each supported language in registration order, with the number of
    corpus files of that extension."""
    langs = [(i + 1, lang) for i, lang in enumerate(REG.default_registry().supported_languages())]
    table = spark.createDataFrame(langs, "ord int, language string")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = C.syn_files(spark, sf_dir).groupBy(ext.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(table).join(files, "language", "right").where("ord is not null").select("ord", "language", F.col("n").alias("n_files")) \
        .unionByName(table.join(files, "language", "left_anti").select("ord", "language", F.lit(0).cast("bigint").alias("n_files")))


def sql_supported_languages():
    langs = REG.default_registry().supported_languages()
    rows = ", ".join(f"({i + 1}, {q(lang)})" for i, lang in enumerate(langs))
    return f"""WITH {C.oracle_files_sql()}
SELECT CAST(o AS INT) AS ord, l AS language, (SELECT count(*) FROM syn_files WHERE ends_with(path, '.' || l)) AS n_files
FROM (VALUES {rows}) v(o, l)"""


def q_function_store_arrays(spark, sf_dir):
    """The three forms of every function, written and read back."""
    out = _scratch(spark, "functions")
    SK.save_functions(C.syn_functions(spark, sf_dir).withColumn("repo", F.regexp_extract("path", r"^src/([^/]*)/", 1)), out)
    text = lambda c: F.array_join(c, "\n").alias(c)
    return SK.load_functions(spark, out).select("func_id", "repo", text("orig"), text("norm"), text("abst"))


def sql_function_store_arrays():
    text = lambda c: f"array_to_string({c}, chr(10)) AS {c}"
    return f"""WITH {C.oracle_files_sql()},\n{ST.oracle_functions_sql()}
SELECT func_id, regexp_extract(path, '^src/([^/]*)/', 1) AS repo, {text('orig')}, {text('norm')}, {text('abst')} FROM syn_functions"""
