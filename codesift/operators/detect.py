"""Signature detectors.

Scale notes
-----------
* A signature catalogue is configuration, not data.  It is unrolled into one
  literal ``rlike`` per pattern inside a projection over the corpus: no join,
  no shuffle, a map-only stage.  A catalogue of more than ``MAX_UNROLLED``
  patterns is looked up in a literal-factor index instead (``indexed``), still
  map-only and in one corpus read; the rows do not depend on its size.
* Every entry point takes its patterns from ``pattern_rows``, which drops the
  invalid ones.
* Output rows are the matches themselves; nothing is collected.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.regex import RE2, check_pattern, is_re2_compatible, re2_compatible, required_literal, to_java, with_reasons
from ..sources import catalog as CAT
from . import indexed

MAX_UNROLLED = 500  # patterns of one projection; more are indexed
MATCH_COLUMNS = ["detector", "sig_id", "name", "severity", "path", "line_start", "line_end",
                 "matched_code", "confidence"]

PY_EXTS = [".py"]
JS_EXTS = [".js", ".jsx", ".ts", ".tsx"]


def pattern_rows(patterns, spark=None) -> list[tuple]:
    """``(sig_id, name, severity, pattern_ord, pattern)`` of a catalogue list,
    a patterns table (column ``pattern``) or a signature table (column
    ``code_patterns``), without the patterns that do not compile or can match
    the empty string (``catalog.validate_patterns`` returns those)."""
    if isinstance(patterns, DataFrame):
        return [tuple(r) for r in valid(raw_patterns(patterns)).toLocalIterator()]
    rows = [(sig_id, name, severity, i, p) for sig_id, name, severity, _desc, pats in patterns for i, p in enumerate(pats)]
    spark = spark or SparkSession.getActiveSession()
    if len(rows) > MAX_UNROLLED:  # checked in the tasks
        rows = spark.createDataFrame(rows, "sig_id string, name string, severity string, pattern_ord int, pattern string")
        return pattern_rows(rows)
    return [r for r in rows if check_pattern(spark, r[4], "python") is None]


PATTERN_FIELDS = "sig_id: string, name: string, severity: string, pattern_ord: int, pattern: string"


def raw_patterns(patterns: DataFrame) -> DataFrame:
    """A patterns or signature table as ``PATTERN_FIELDS``."""
    if "code_patterns" in patterns.columns:
        patterns = patterns.select("sig_id", "name", "severity",
                                   F.posexplode("code_patterns").alias("pattern_ord", "pattern"))
    return patterns.select("sig_id", "name", "severity", "pattern_ord", "pattern")


def valid(rows: DataFrame) -> DataFrame:
    """The rows whose ``pattern`` compiles and does not match the empty string."""
    return with_reasons(rows, "python").where("reason is null").select(*rows.columns)


TASK_BYTES = 1 << 20  # of a large catalogue, analysed by one task


def large_table(rows: DataFrame) -> DataFrame | None:
    """The valid ones of the ``rows`` of a catalogue beyond ``indexed.INDEX_BYTES``,
    which the driver does not collect; None of a smaller one."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(indexed.table_size(rows))).first()
    if n <= MAX_UNROLLED or size <= indexed.INDEX_BYTES:
        return None
    # a table of patterns is few bytes for its work: dealt out beyond its input splits
    return valid(rows.repartition(min(10_000, -(-size // TASK_BYTES))))


def catalogue_rows(patterns, spark: SparkSession):
    """``pattern_rows``, or ``large_table`` of a large catalogue."""
    if isinstance(patterns, DataFrame):
        table = large_table(raw_patterns(patterns))
    else:
        rows = [(sig_id, name, severity, i, p) for sig_id, name, severity, _desc, pats in patterns for i, p in enumerate(pats)]
        large = len(rows) > MAX_UNROLLED and sum(map(indexed._size, rows)) > indexed.INDEX_BYTES
        table = large_table(spark.createDataFrame(rows, PATTERN_FIELDS)) if large else None
    return pattern_rows(patterns, spark) if table is None else table


def re2_rows(rows):
    """Those of ``catalogue_rows`` that RE2 compiles."""
    if isinstance(rows, DataFrame):
        return rows.where(is_re2_compatible(F.col("pattern")))
    return [r for r in rows if re2_compatible(r[4])]


def in_chunks(rows: list, project, empty: DataFrame) -> DataFrame:
    """Union of ``project(chunk)`` over chunks of ``MAX_UNROLLED`` rows."""
    out = None
    for i in range(0, len(rows), MAX_UNROLLED):
        part = project(rows[i:i + MAX_UNROLLED])
        out = part if out is None else out.unionByName(part)
    return empty if out is None else out


def literal_guard(col: Column, pattern: str) -> Column:
    """``contains(required literal)`` in front of a regex: a cheap test that
    skips the regex engine on rows that cannot match (exact, see
    ``required_literal``)."""
    lit = required_literal(pattern)
    return col.contains(lit) if lit else F.lit(True)


def ext_filter(path_col: Column, exts: Sequence[str]) -> Column:
    """Case-sensitive extension test, as ``filepath.Ext(path) == ext``."""
    return F.regexp_extract(path_col, r"(\.[^./]*)$", 1).isin(list(exts))


# --- D3: line-wise detector ----------------------------------------------------

def detect_lines(lines: DataFrame, patterns, rule: str = "G-py", detector: str = "python",
                 exts: Sequence[str] | None = None, keep_non_re2: bool = False) -> DataFrame:
    """D3: one match per (line, signature, pattern); matched_code = the line.

    ``lines`` has ``path, line_no, text``.  Go's line reader drops a trailing
    ``\\r``; patterns RE2 cannot compile are skipped unless ``keep_non_re2``.
    """
    if exts is not None:
        lines = lines.where(ext_filter(F.col("path"), exts))
    text = F.regexp_replace(F.col("text"), r"\r$", "")
    rows = catalogue_rows(patterns, lines.sparkSession)
    if not keep_non_re2:
        rows = re2_rows(rows)
    if isinstance(rows, DataFrame) or len(rows) > MAX_UNROLLED:
        return _indexed_lines(lines.select("path", "line_no", text.alias("code")), rows, rule, detector)

    def project(chunk):
        hits = [F.when(literal_guard(text, pattern) & text.rlike(TX.java_for_rule(pattern, rule)), F.struct(
            F.lit(sig_id).alias("sig_id"), F.lit(name).alias("name"), F.lit(severity).alias("severity"),
            F.lit(ordinal).alias("pattern_ord"), F.lit(len(pattern.encode("utf-8"))).alias("plen")))
            for sig_id, name, severity, ordinal, pattern in chunk]
        found = F.filter(F.array(*hits), lambda h: h.isNotNull())
        exploded = (lines.select("path", "line_no", text.alias("code"), found.alias("hits"))
                    .select("path", "line_no", "code", F.explode("hits").alias("h")))
        return exploded.select(
            F.lit(detector).alias("detector"), F.col("h.sig_id").alias("sig_id"),
            F.col("h.name").alias("name"), F.col("h.severity").alias("severity"), "path",
            F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"),
            F.col("code").alias("matched_code"),
            TX.confidence(F.col("code"), F.col("h.plen"), rule).alias("confidence"))

    return in_chunks(rows, project, lines.sparkSession.createDataFrame([], match_schema()))


def _java_pairs(texts: DataFrame, text: str, catalogue, rule: str, in_bytes: bool) -> DataFrame:
    """The pairs of texts and patterns of a list or table that may match, with the
    Java pattern and the length of the pattern's text."""
    if isinstance(catalogue, DataFrame):
        plen = F.octet_length("pattern") if in_bytes else F.length("pattern")
        return indexed.candidates_of(texts, text, catalogue.select(
            "*", F.concat(F.lit(TX.java_for_rule("", rule)), F.col("pattern")).alias("java"), plen.alias("plen")))
    java = [(*r[:4], TX.java_for_rule(r[4], rule), len(r[4].encode("utf-8") if in_bytes else r[4]), r[4]) for r in catalogue]
    return indexed.candidates(texts, text, java, PATTERN_FIELDS.replace("pattern: string", "java: string, plen: int, pattern: string"))


def _indexed_lines(lines: DataFrame, catalogue, rule: str, detector: str) -> DataFrame:
    """D3 through the literal-factor index: ``lines(path, line_no, code)``."""
    return _java_pairs(lines, "code", catalogue, rule, True).where(F.rlike("code", F.col("java"))).select(
        F.lit(detector).alias("detector"), "sig_id", "name", "severity", "path", F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"), F.col("code").alias("matched_code"),
        TX.confidence(F.col("code"), F.col("plen"), rule).alias("confidence"))


def match_schema() -> str:
    return ("detector string, sig_id string, name string, severity string, path string, "
            "line_start int, line_end int, matched_code string, confidence double")


# --- D2: all-match whole-file detector -------------------------------------------

def _file_hits(files: DataFrame, specs: list[tuple], content: Column) -> DataFrame:
    """Explode every non-overlapping match of every pattern in every file.

    ``specs``: (sig_id, name, severity, pattern_ord, java_pattern, plen).
    A cheap ``rlike`` guard skips the split/extract work on files without a
    hit for that pattern.
    """
    per = []
    for spec in specs:
        sig_id, name, severity, ordinal, jp, plen = spec[:6]
        guard = literal_guard(content, spec[6]) if len(spec) > 6 else F.lit(True)
        per.append(F.when(guard & content.rlike(jp), F.struct(
            F.lit(sig_id).alias("sig_id"), F.lit(name).alias("name"), F.lit(severity).alias("severity"),
            F.lit(ordinal).alias("pattern_ord"), F.lit(plen).alias("plen"),
            TX.all_matches(content, jp).alias("ms"))))
    found = F.filter(F.array(*per), lambda h: h.isNotNull())
    return (files.select("path", found.alias("hits"))
            
            .select("path", F.explode("hits").alias("h"))
            .select("path", "h.sig_id", "h.name", "h.severity", "h.pattern_ord", "h.plen",
                    F.explode("h.ms").alias("m")))


def detect_all(files: DataFrame, patterns, rule: str = "P", detector: str = "signature",
               min_confidence: float = 0.7, keep_non_re2: bool = True) -> DataFrame:
    """Every match in the whole file (may span lines), confidence by rule
    ``P`` (Python CLI) or ``G-vul`` (Go signature detector); keep >= threshold."""
    rows = catalogue_rows(patterns, files.sparkSession)
    if rule != "P" and not keep_non_re2:
        rows = re2_rows(rows)
    if isinstance(rows, DataFrame) or len(rows) > MAX_UNROLLED:
        return min_confidence_filter(_indexed_files(files, rows, rule, detector), min_confidence)

    def project(chunk):
        specs = [(sig_id, name, severity, ordinal, TX.java_for_rule(pattern, rule),
                  len(pattern) if rule == "P" else len(pattern.encode("utf-8")), pattern)
                 for sig_id, name, severity, ordinal, pattern in chunk]
        hits = _file_hits(files, specs, F.col("content"))
        return hits.select(
            F.lit(detector).alias("detector"), "sig_id", "name", "severity", "path",
            F.col("m.line_start").alias("line_start"), F.col("m.line_end").alias("line_end"),
            F.col("m.text").alias("matched_code"),
            TX.confidence(F.col("m.text"), F.col("plen"), rule).alias("confidence"))

    out = in_chunks(rows, project, files.sparkSession.createDataFrame([], match_schema()))
    return min_confidence_filter(out, min_confidence)


def _indexed_files(files: DataFrame, catalogue, rule: str, detector: str) -> DataFrame:
    """D2 through the literal-factor index."""
    pairs = _java_pairs(files.select("path", "content"), "content", catalogue, rule, rule != "P")
    hits = pairs.where(F.rlike("content", F.col("java"))) \
        .select("path", "sig_id", "name", "severity", "plen", F.explode(TX.all_matches(F.col("content"), F.col("java"))).alias("m"))
    return hits.select(
        F.lit(detector).alias("detector"), "sig_id", "name", "severity", "path", F.col("m.line_start").alias("line_start"),
        F.col("m.line_end").alias("line_end"), F.col("m.text").alias("matched_code"),
        TX.confidence(F.col("m.text"), F.col("plen"), rule).alias("confidence"))


# --- D5 / D6: block checks ------------------------------------------------------

def block_checks(files: DataFrame, language: str = "python") -> DataFrame:
    """D5 (PY011/PY012) and D6 (JS011/JS012): whole-file RE2 checks with a
    fixed confidence; the line is that of the match start."""
    table = CAT.PYTHON_BLOCK_CHECKS if language == "python" else CAT.JAVASCRIPT_BLOCK_CHECKS
    exts = PY_EXTS if language == "python" else JS_EXTS
    files = files.where(ext_filter(F.col("path"), exts))
    specs = [(sig_id, name, sev, 0, to_java(p, RE2), len(p)) for sig_id, name, sev, _d, p, _c, _s in table]
    conf = {t[0]: t[5] for t in table}
    suffix = {t[0]: t[6] for t in table}
    hits = _file_hits(files, specs, F.col("content"))
    conf_col = F.coalesce(*[F.when(F.col("sig_id") == k, F.lit(v)) for k, v in conf.items()])
    suffix_col = F.coalesce(*[F.when(F.col("sig_id") == k, F.lit(v)) for k, v in suffix.items()])
    return hits.select(
        F.lit(language).alias("detector"), "sig_id", "name", "severity", "path",
        F.col("m.line_start").alias("line_start"), F.col("m.line_start").alias("line_end"),
        F.concat(F.col("m.text"), suffix_col).alias("matched_code"),
        conf_col.cast("double").alias("confidence"))


# --- F1 / D9 ---------------------------------------------------------------------

def min_confidence_filter(matches: DataFrame, tau: float = 0.7) -> DataFrame:
    """keep ``confidence >= tau`` (exact double comparison, as upstream)."""
    return matches.where(F.col("confidence") >= F.lit(tau))


def run_detectors(inputs: Iterable[DataFrame], min_confidence: float = 0.7) -> DataFrame:
    """Union of detector outputs, then the threshold."""
    out = None
    for df in inputs:
        df = df.select(*MATCH_COLUMNS)
        out = df if out is None else out.unionByName(df)
    return min_confidence_filter(out, min_confidence)


def scan_files_fused(files: DataFrame, line_groups, block_languages=("python", "javascript"),
                     keep_non_re2: bool = False) -> DataFrame:
    """D3 + D5/D6 fused into ONE projection over ``files(path, content)``.

    Each file row yields its line-wise hits (a higher-order ``transform`` over
    its lines, every pattern guarded by the detector's extension) and its
    whole-file block-check hits; one ``explode`` emits them.  One read of
    the corpus, no union, no second scan: with ``binaryFile`` input the whole
    directory scan is a single map-only stage.
    """
    ext = F.regexp_extract(F.col("path"), r"(\.[^./]*)$", 1)
    # lines are stripped here: in the lambda every pattern would strip its line again
    lines = F.transform(F.split(F.col("content"), "\n", -1),
                        lambda x: F.when(x.contains("\r"), F.regexp_replace(x, r"\r$", "")).otherwise(x))
    files = files.select("path", "content", ext.alias("_ext"), lines.alias("_lines"))
    rec = lambda det, sig, name, sev, ls, le, code, conf: F.struct(
        F.lit(det).alias("detector"), F.lit(sig).alias("sig_id"), F.lit(name).alias("name"),
        F.lit(sev).alias("severity"), ls.cast("int").alias("line_start"), le.cast("int").alias("line_end"),
        code.alias("matched_code"), conf.cast("double").alias("confidence"))

    def line_hits(text, i):
        hs = []
        for catalog, rule, detector, exts in line_groups:
            applies = F.col("_ext").isin(list(exts))
            for sig_id, name, severity, _o, pattern in pattern_rows(catalog):
                if not keep_non_re2 and not re2_compatible(pattern):
                    continue
                jp = TX.java_for_rule(pattern, rule)
                hs.append(F.when(applies & literal_guard(text, pattern) & text.rlike(jp), rec(
                    detector, sig_id, name, severity, i + 1, i + 1, text,
                    TX.confidence(text, len(pattern.encode("utf-8")), rule))))
        return F.filter(F.array(*hs), lambda h: h.isNotNull())

    per_line = F.flatten(F.transform("_lines", line_hits))
    content = F.col("content")
    blocks = []
    for language in block_languages:
        table = CAT.PYTHON_BLOCK_CHECKS if language == "python" else CAT.JAVASCRIPT_BLOCK_CHECKS
        applies = F.col("_ext").isin(PY_EXTS if language == "python" else JS_EXTS)
        for sig_id, name, sev, _d, p, conf, suffix in table:
            jp = to_java(p, RE2)
            ms = F.when(applies & literal_guard(content, p) & content.rlike(jp), TX.all_matches(content, jp)).otherwise(
                F.array().cast("array<struct<idx:int,text:string,line_start:int,line_end:int,offset:int>>"))
            def to_rec(language=language, sig_id=sig_id, name=name, sev=sev, conf=conf, suffix=suffix):
                return lambda m: rec(language, sig_id, name, sev, m["line_start"], m["line_start"],
                                     F.concat(m["text"], F.lit(suffix)), F.lit(conf))
            blocks.append(F.transform(ms, to_rec()))
    allhits = F.concat(per_line, *blocks)
    return files.select("path", F.explode(allhits).alias("h")).select(
        "h.detector", "h.sig_id", "h.name", "h.severity", "path", "h.line_start", "h.line_end",
        "h.matched_code", "h.confidence")


GO_LINE_GROUPS = [(CAT.PYTHON_CATALOG, "G-py", "python", PY_EXTS),
                  (CAT.JAVASCRIPT_CATALOG, "G-js", "javascript", JS_EXTS)]


def go_directory_scan(files: DataFrame, lines: DataFrame | None = None, min_confidence: float = 0.7) -> DataFrame:
    """The Go scanner's directory scan: python and javascript detectors
    (line-wise catalogues + block checks), union, threshold — as ONE fused
    map-only pass over the files (``scan_files_fused``).  ``lines`` is
    accepted for API symmetry and not needed."""
    return run_detectors([scan_files_fused(files, GO_LINE_GROUPS)], min_confidence)


# --- D4 + J12: first-match detector of the Python CLI --------------------------------

def applicable(files: DataFrame, strict_ext: bool = False) -> DataFrame:
    """Adds ``_lang``, the key a signature's ``affected_languages`` is
    tested against (per pattern, in ``detect_first``).

    ``strict_ext=True`` reproduces the reference, which compares the raw
    extension (``py``) with language names (``python``).
    """
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]*)$", 1))
    if strict_ext:
        key = ext
    else:
        key = F.coalesce(*[F.when(ext == e.lstrip("."), F.lit(lang)) for e, lang in CAT.EXTENSION_LANGUAGE])
    return files.withColumn("_lang", key)


def detect_first(files: DataFrame, signatures, strict_ext: bool = False, context_lines: int = 3) -> DataFrame:
    """At most one match per (file, signature, pattern), MULTILINE,
    confidence 0.5, matched_code = the T10 context snippet.

    Signature applicability (J12) is evaluated per pattern as a literal
    ``array_contains`` on the file's language.  Fix-pattern similarity (J15)
    is applied separately by ``fix_similarity``.
    """
    spark = files.sparkSession
    if isinstance(signatures, DataFrame):
        each = signatures.select("sig_id", "name", "severity", F.col("affected_languages").alias("languages"),
                                 F.posexplode("code_patterns").alias("pattern_ord", "pattern"))
        rows = large_table(each)
        if rows is None:
            rows = [tuple(r) for r in valid(each).toLocalIterator()]
    else:
        rows = [(r["sig_id"], r["name"], r["severity"], list(r["affected_languages"]), i, p)
                for r in signatures for i, p in enumerate(r["code_patterns"]) if check_pattern(spark, p, "python") is None]
    tagged = applicable(files, strict_ext)
    content = F.col("content")
    # Python ``splitlines`` also breaks on \r; the corpus is \n-normalised.
    lines_arr = F.split(F.regexp_replace(F.col("content"), r"\n\z", ""), "\n", -1)
    if isinstance(rows, DataFrame) or len(rows) > MAX_UNROLLED:
        return _indexed_first(tagged, rows, lines_arr, context_lines)

    def project(chunk):
        per = []
        for sig_id, name, severity, languages, i, p in chunk:
            jp = to_java(p, "python", multiline=True)
            text = F.regexp_extract(content, jp, 0)
            start = TX.newline_count(F.split(content, jp, 2)[0]) + 1  # lines before the first match
            m = F.struct(start.cast("int").alias("line_start"),
                         (start + TX.newline_count(text)).cast("int").alias("line_end"))
            per.append(F.when(F.col("_lang").isin(languages) & literal_guard(content, p) & content.rlike(jp), F.struct(
                F.lit(sig_id).alias("sig_id"), F.lit(name).alias("name"),
                F.lit(severity).alias("severity"), F.lit(i).alias("pattern_ord"), m.alias("m"))))
        found = F.filter(F.array(*per), lambda h: h.isNotNull())
        hits = (tagged.select("path", "content", found.alias("hits"))
                .select("path", lines_arr.alias("ls"), F.explode("hits").alias("h")))
        snippet = TX.context_snippet(F.col("ls"), F.col("h.m.line_start"), F.col("h.m.line_end"), context_lines)
        return hits.select(
            F.lit("first").alias("detector"), F.col("h.sig_id").alias("sig_id"), F.col("h.name").alias("name"),
            F.col("h.severity").alias("severity"), "path",
            F.col("h.m.line_start").alias("line_start"), F.col("h.m.line_end").alias("line_end"),
            snippet.alias("matched_code"), F.lit(0.5).alias("confidence"),
            F.col("h.pattern_ord").alias("pattern_ord"))

    return in_chunks(rows, project, spark.createDataFrame([], match_schema() + ", pattern_ord int"))


def _indexed_first(files: DataFrame, catalogue, lines_arr: Column, context_lines: int) -> DataFrame:
    """D4 through the literal-factor index: ``files(path, content, _lang)``."""
    texts = files.select("path", "content", "_lang")
    content, jp = F.col("content"), F.col("java")
    if isinstance(catalogue, DataFrame):
        pairs = indexed.candidates_of(texts, "content", catalogue.withColumn(
            "java", F.concat(F.lit(to_java("", "python", multiline=True)), F.col("pattern"))))
    else:
        java = [(*r[:3], list(r[3]), r[4], to_java(r[5], "python", multiline=True), r[5]) for r in catalogue]
        fields = ("sig_id: string, name: string, severity: string, languages: array<string>, pattern_ord: int, java: string, "
                  "pattern: string")
        pairs = indexed.candidates(texts, "content", java, fields)
    hits = pairs.where(F.array_contains("languages", F.col("_lang")) & F.rlike(content, jp))
    text = F.call_function("regexp_extract", content, jp, F.lit(0))
    hits = hits.withColumn("line_start", (TX.newline_count(F.split(content, jp, 2)[0]) + 1).cast("int")) \
        .withColumn("line_end", (F.col("line_start") + TX.newline_count(text)).cast("int"))
    snippet = TX.context_snippet(lines_arr, F.col("line_start"), F.col("line_end"), context_lines)
    return hits.select(F.lit("first").alias("detector"), "sig_id", "name", "severity", "path", "line_start", "line_end",
                       snippet.alias("matched_code"), F.lit(0.5).alias("confidence"), "pattern_ord")


# --- T12 -------------------------------------------------------------------------

def normalize_severity(matches: DataFrame) -> DataFrame:
    """Map CRITICAL/HIGH/..., high/medium/low and the Chinese labels to
    one lower-case scale with a rank; unknown labels are kept as they are.
    The scale is an 11-row literal, broadcast."""
    scale = CAT.severity_scale(matches.sparkSession)
    j = matches.join(F.broadcast(scale), "severity", "left")
    return j.withColumn("severity_norm", F.coalesce("severity_norm", "severity"))
