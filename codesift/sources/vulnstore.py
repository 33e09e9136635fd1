"""Vulnerability-store and tag sources.

On-disk layout of a store directory (one file per vulnerability index, as
the upstream dataset is laid out):

* ``oss_idx.txt``           lines ``oss@@vuln_idx`` (one-to-many)
* ``idx2cve.txt``           lines ``vuln_idx##cve`` (last wins)
* ``vulHashes/<oss>_hash.txt``        lines ``md5<TAB>...``
* ``vulBodySet/<idx>_*.json``         ``{vul_body: [..], old_body?: [..]}``
* ``vulESSLines/<idx>_common.txt``    JSON list of ``{vul_body, abs_body}``
* ``noOldESSLines/<idx>_minus.txt``   same shape
* ``patESSLines/<idx>_plus.txt``      JSON list of ``{pat_body, abs_body}``
* ``vulDEPLines/<idx>_depen.txt``, ``noOldDEPLines/...``
  ``{vul?: {key: [{abs_norm_vul, orig_norm_vul}]}, old?: {...}}`` or bare ``{key: [...]}``

Every file is read by Spark's text/JSON sources; the vulnerability index
comes from the file name (``_metadata.file_name``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARR = T.ArrayType(T.StringType())


def _file_name():
    """The source file's name; ``_metadata.file_name`` is URI-encoded."""
    raw = F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B")
    return F.url_decode(raw)


def _text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return (spark.read.option("wholetext", str(whole).lower()).text(path)
            .select("value", _file_name().alias("file_name")))


def _has_files(spark: SparkSession, pattern: str) -> bool:
    """True when the glob matches at least one file (any Hadoop filesystem)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def _idx(file_name_col, suffix_regex: str):
    return F.regexp_extract(file_name_col, r"^(.*?)" + suffix_regex, 1)


def load_vuln_store(spark: SparkSession, root: str) -> dict:
    """The seven store tables of a store directory."""
    root = root.rstrip("/")
    lines = _text(spark, f"{root}/oss_idx.txt").where(F.trim("value") != "")
    oss_idx = lines.select(F.split("value", "@@").getItem(0).alias("oss"),
                           F.split("value", "@@").getItem(1).alias("vuln_idx"))
    cve_lines = _text(spark, f"{root}/idx2cve.txt").where(F.trim("value") != "")
    # last line wins for one index: keep the max line position within the file
    cve = cve_lines.select(F.split("value", "##").getItem(0).alias("vuln_idx"),
                           F.split("value", "##").getItem(1).alias("cve"),
                           F.monotonically_increasing_id().alias("pos"))
    vuln_cve = cve.groupBy("vuln_idx").agg(F.max_by("cve", "pos").alias("cve"))
    hashes = _text(spark, f"{root}/vulHashes/*_hash.txt").where(F.trim("value") != "")
    vuln_hash = hashes.select(_idx(F.col("file_name"), r"_hash\.txt$").alias("oss"),
                              F.split("value", "\t").getItem(0).alias("hash"))
    body_schema = T.StructType([T.StructField("vul_body", _ARR), T.StructField("old_body", _ARR)])
    bodies = spark.read.schema(body_schema).option("multiLine", "true").json(f"{root}/vulBodySet/*")
    vuln_body = bodies.select(_idx(_file_name(), r"_.*$").alias("vuln_idx"),
                              "vul_body", "old_body")
    ess_schema = T.ArrayType(T.StructType([T.StructField("vul_body", T.StringType()),
                                           T.StructField("abs_body", T.StringType())]))
    ess_parts = []
    for sub, kind in (("vulESSLines", "common"), ("noOldESSLines", "minus")):
        p = f"{root}/{sub}/*_{kind}.txt"
        if _has_files(spark, p):
            t = _text(spark, p, whole=True)
            ess_parts.append(t.select(_idx(F.col("file_name"), f"_{kind}\\.txt$").alias("vuln_idx"),
                                      F.lit(kind).alias("kind"),
                                      F.explode(F.from_json("value", ess_schema)).alias("e"))
                             .select("vuln_idx", "kind", "e.vul_body", "e.abs_body"))
    ess_lines = _union(spark, ess_parts, "vuln_idx string, kind string, vul_body string, abs_body string")
    pat_schema = T.ArrayType(T.StructType([T.StructField("pat_body", T.StringType()),
                                           T.StructField("abs_body", T.StringType())]))
    pat_parts = []
    if _has_files(spark, f"{root}/patESSLines/*_plus.txt"):
        t = _text(spark, f"{root}/patESSLines/*_plus.txt", whole=True)
        pat_parts.append(t.select(_idx(F.col("file_name"), r"_plus\.txt$").alias("vuln_idx"),
                                  F.explode(F.from_json("value", pat_schema)).alias("e"))
                         .select("vuln_idx", "e.pat_body", "e.abs_body"))
    pat_lines = _union(spark, pat_parts, "vuln_idx string, pat_body string, abs_body string")
    # dependency lines count only beside the essential lines in use: those of
    # vulDEPLines with ``_common``, those of noOldDEPLines with ``_minus``
    common = ess_lines.where("kind = 'common'").select("vuln_idx").distinct()
    minus = ess_lines.where("kind = 'minus'").select("vuln_idx").distinct().join(common, "vuln_idx", "left_anti")
    dep_of = {"vulDEPLines": common, "noOldDEPLines": minus}
    dep_parts = []
    for sub in ("vulDEPLines", "noOldDEPLines"):
        if _has_files(spark, f"{root}/{sub}/*_depen.txt"):
            deps = _dep_lines(_text(spark, f"{root}/{sub}/*_depen.txt", whole=True))
            dep_parts.append(deps.join(dep_of[sub], "vuln_idx", "left_semi"))
    dep_lines = _union(spark, dep_parts, "vuln_idx string, origin string, dep_key string, "
                                         "abs_norm_vul string, orig_norm_vul string")
    return {"oss_idx": oss_idx, "vuln_cve": vuln_cve, "vuln_hash": vuln_hash, "vuln_body": vuln_body,
            "ess_lines": ess_lines, "pat_lines": pat_lines, "dep_lines": dep_lines}


def _dep_lines(t: DataFrame) -> DataFrame:
    entry = T.ArrayType(T.StructType([T.StructField("abs_norm_vul", T.StringType()),
                                      T.StructField("orig_norm_vul", T.StringType())]))
    deps = T.MapType(T.StringType(), entry)
    top = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    t = t.select(_idx(F.col("file_name"), r"_depen\.txt$").alias("vuln_idx"), "value", top.alias("top"))
    wrapped = F.array_contains(F.map_keys("top"), "vul") | F.array_contains(F.map_keys("top"), "old")
    # wrapped form: {vul: {...}, old: {...}}; bare form: {key: [...]} == origin vul
    w = t.where(wrapped).select("vuln_idx", F.explode("top").alias("origin", "js")).where(
        F.col("origin").isin("vul", "old")).select("vuln_idx", "origin", F.from_json("js", deps).alias("m"))
    b = t.where(~wrapped).select("vuln_idx", F.lit("vul").alias("origin"), F.from_json("value", deps).alias("m"))
    both = w.unionByName(b).select("vuln_idx", "origin", F.explode("m").alias("dep_key", "entries"))
    return both.select("vuln_idx", "origin", "dep_key", F.explode("entries").alias("e")).select(
        "vuln_idx", "origin", "dep_key", "e.abs_norm_vul", "e.orig_norm_vul")


def _union(spark, parts, schema):
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _store_files(store: dict) -> DataFrame:
    """``(file, content)`` rows of a store directory; a row holds what one
    vulnerability (or one project's hash list, or an index) has."""
    def one_file(rows, file, item, head="[", sep=",", tail="]"):
        text = F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(item)), sep), F.lit(tail))
        return rows.groupBy(file.alias("file")).agg(text.alias("content"))

    def lines_file(rows, file, item):
        return one_file(rows, file, item, "", "\n", "")

    idx = F.col("vuln_idx")
    ess, deps = store["ess_lines"], store["dep_lines"]
    ess_file = F.when(F.col("kind") == "common", F.concat(F.lit("vulESSLines/"), idx, F.lit("_common.txt"))) \
        .otherwise(F.concat(F.lit("noOldESSLines/"), idx, F.lit("_minus.txt")))
    with_common = ess.where("kind = 'common'").select("vuln_idx", F.lit(True).alias("common")).distinct()
    # dependency lines lie beside the essential lines that are in use
    entries = deps.groupBy("vuln_idx", "origin", "dep_key").agg(
        F.sort_array(F.collect_list(F.struct("abs_norm_vul", "orig_norm_vul"))).alias("es"))
    origins = entries.groupBy("vuln_idx", "origin").agg(
        F.map_from_entries(F.collect_list(F.struct("dep_key", "es"))).alias("keys"))
    docs = origins.groupBy("vuln_idx").agg(F.map_from_entries(F.collect_list(F.struct("origin", "keys"))).alias("doc"))
    dep_dir = F.when(F.col("common"), F.lit("vulDEPLines/")).otherwise(F.lit("noOldDEPLines/"))
    parts = [
        lines_file(store["oss_idx"], F.lit("oss_idx.txt"), F.concat_ws("@@", "oss", "vuln_idx")),
        lines_file(store["vuln_cve"], F.lit("idx2cve.txt"), F.concat_ws("##", "vuln_idx", "cve")),
        lines_file(store["vuln_hash"], F.concat(F.lit("vulHashes/"), F.col("oss"), F.lit("_hash.txt")),
                   F.concat(F.col("hash"), F.lit("\tx"))),
        store["vuln_body"].select(
            F.concat(F.lit("vulBodySet/"), idx, F.lit("_body.json")).alias("file"),
            F.to_json(F.struct(F.coalesce("vul_body", F.array().cast("array<string>")).alias("vul_body"),
                               "old_body")).alias("content")),
        one_file(ess, ess_file, F.to_json(F.struct("vul_body", "abs_body"))),
        one_file(store["pat_lines"], F.concat(F.lit("patESSLines/"), idx, F.lit("_plus.txt")),
                 F.to_json(F.struct("pat_body", "abs_body"))),
        docs.join(with_common, "vuln_idx", "left").select(
            F.concat(dep_dir, idx, F.lit("_depen.txt")).alias("file"), F.to_json("doc").alias("content"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_vuln_store(store: dict, root: str) -> None:
    """Write store tables in the directory layout above.

    The content of each file is put together by Spark and written by the
    task that holds it, so nothing passes through the driver; a repeated
    task writes the same bytes again.  The two index files are one row each,
    a line per vulnerability.  ``root`` is a shared folder or a URI that
    ``pyarrow.fs`` knows (``file:``, ``hdfs:``, ``s3:``, ``gs:``)."""
    base = re.sub(r"^s3[an]:", "s3:", root.rstrip("/"))
    base = re.sub(r"^file:/+", "/", base)

    def put(rows):
        from pyarrow import fs as pafs

        fs, folder = pafs.FileSystem.from_uri(base)
        for row in rows:
            target = f"{folder}/{row.file}"
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(target) as out:
                out.write((row.content or "").encode("utf-8"))

    _store_files(store).foreachPartition(put)


def load_tags(spark: SparkSession, path: str) -> DataFrame:
    """Ctags TSV (``--fields=neKSt``) -> ``path, name, kind, line, end_line, typeref``.

    ``typeref:<kind>:<T>`` keeps ``T`` with a trailing `` *`` removed.
    """
    t = spark.read.text(path).where(F.col("value") != "")
    parts = F.split("value", "\t")
    return t.select(
        parts.getItem(1).alias("path"), parts.getItem(0).alias("name"),
        F.coalesce(F.when(parts.getItem(3).isin("function", "parameter", "local"), parts.getItem(3)),
                   F.when(parts.getItem(4).isin("function", "parameter", "local"), parts.getItem(4)),
                   parts.getItem(3)).alias("kind"),
        F.regexp_extract("value", r"\tline:(\d+)", 1).cast("int").alias("line"),
        F.regexp_extract("value", r"\tend:(\d+)", 1).cast("int").alias("end_line"),
        F.nullif(F.regexp_replace(F.regexp_extract("value", r"\ttyperef:\w*:([^\t]*)", 1), r" \*$", ""),
                 F.lit("")).alias("typeref"))
