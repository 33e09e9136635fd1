"""A vulnerability store derived from the driver tables (S8's tables).

The reference ships no store, and the driver tables hold no CVEs, so the
store is derived by a fixed rule over whole tables: every nation is a
project (its region is the OSS that reuses it) whose orders, by
``(o_orderdate, o_orderkey)``, are successive versions of one function:

* the earliest order is the *oldest vulnerable* version (``old_body``),
* the second earliest is the *vulnerable* version (``vul_body``),
* the latest is the *patched* version.

Essential lines are the lines the patch deleted (``common`` when the oldest
version also has them, else ``minus``); patch lines are the lines it added;
dependency lines are the ``import`` lines of the vulnerable and oldest
versions.  The store has one vulnerability per nation — a fixed size, like a
CVE database, while the target corpus grows with the scale factor.

Version picking uses partial aggregates (``min``/``max`` of a struct), never
a window over a nation: each nation's orders are a hot group by design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import corpus as C


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nationkey, n_name, regionkey, r_name, version, orderkey`` (3 per nation)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("c_nationkey").alias("nationkey"), F.struct("o_orderdate", "o_orderkey").alias("k"))
    ends = oc.groupBy("nationkey").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    firsts = F.broadcast(ends.select("nationkey", F.col("first.o_orderkey").alias("fk")))  # one row per nation
    rest = oc.join(firsts, (oc.nationkey == firsts.nationkey) & (oc.k.o_orderkey == firsts.fk), "left_anti")
    second = rest.groupBy("nationkey").agg(F.min("k").alias("second"))
    v = ends.join(second, "nationkey").select(
        "nationkey", F.explode(F.array(
            F.struct(F.lit("old").alias("version"), F.col("first.o_orderkey").alias("orderkey")),
            F.struct(F.lit("vul").alias("version"), F.col("second.o_orderkey").alias("orderkey")),
            F.struct(F.lit("pat").alias("version"), F.col("last.o_orderkey").alias("orderkey")))).alias("v"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nationkey"), "n_name", F.col("n_regionkey").alias("regionkey"), "r_name")
    return v.join(F.broadcast(geo), "nationkey").select(
        "nationkey", "n_name", "regionkey", "r_name", "v.version", "v.orderkey")


def version_functions(spark: SparkSession, sf_dir: str, vers: DataFrame, c_view: bool = False) -> DataFrame:
    """The three forms of every version's function (75 functions).

    A semi-join keeps the versions' lines before files are put together; the
    written version table is sized by its bytes, so Catalyst broadcasts its
    three keys per nation and would shuffle a larger one."""
    keys = vers.select(F.col("orderkey").alias("l_orderkey")).distinct()
    li = C.lineitem(spark, sf_dir).join(keys, "l_orderkey", "left_semi")
    files = C.syn_files(spark, sf_dir, source=li)
    fn = C.syn_c_functions(spark, sf_dir, files) if c_view else C.syn_functions(spark, sf_dir, files)
    vid = F.concat(F.lit("V"), F.lpad(F.col("nationkey").cast("string"), 2, "0"))
    return vers.join(fn, vers.orderkey == fn.file_id).select(
        vid.alias("vuln_idx"), "nationkey", "regionkey", "r_name", "version", "norm", "abst", "norm_hash")


def _lines(vf: DataFrame, version: str) -> DataFrame:
    return vf.where(F.col("version") == version).select(
        "vuln_idx", F.explode(F.arrays_zip("norm", "abst")).alias("z")).select(
        "vuln_idx", F.col("z.norm").alias("norm"), F.col("z.abst").alias("abst"))


def build_store(spark: SparkSession, sf_dir: str, c_view: bool = False) -> dict:
    """All store tables as DataFrames (small, fixed size: 25 vulnerabilities).
    ``c_view`` builds the versions from the C view of the corpus (functions
    extracted by brace depth)."""
    vers = materialize(versions(spark, sf_dir), "versions")
    vf = materialize(version_functions(spark, sf_dir, vers, c_view), "version-functions")
    ids = vf.select("vuln_idx", "nationkey", "regionkey", "r_name").distinct()
    oss_idx = ids.select(F.col("r_name").alias("oss"), "vuln_idx")
    vuln_cve = ids.select("vuln_idx", F.concat(
        F.lit("CVE-"), (F.col("regionkey") + 2000).cast("string"), F.lit("-"),
        F.lpad(F.col("nationkey").cast("string"), 4, "0")).alias("cve"))
    vuln_hash = vf.where(F.col("version").isin("vul", "old")).select(
        F.col("r_name").alias("oss"), F.col("norm_hash").alias("hash")).distinct()
    body = vf.groupBy("vuln_idx").agg(
        F.first(F.when(F.col("version") == "vul", F.col("norm")), ignorenulls=True).alias("vul_body"),
        F.first(F.when(F.col("version") == "old", F.col("norm")), ignorenulls=True).alias("old_body"))
    vul, old, pat = _lines(vf, "vul"), _lines(vf, "old"), _lines(vf, "pat")
    pat_set = pat.select("vuln_idx", F.col("norm").alias("pn")).distinct()
    old_set = old.select("vuln_idx", F.col("norm").alias("on")).distinct()
    deleted = (vul.where(F.col("norm") != "").join(pat_set, (vul.vuln_idx == pat_set.vuln_idx) &
                                                   (vul.norm == pat_set.pn), "left_anti"))
    minus = deleted.select("vuln_idx", F.lit("minus").alias("kind"), F.col("norm").alias("vul_body"),
                           F.col("abst").alias("abs_body"))
    common = deleted.join(old_set, (deleted.vuln_idx == old_set.vuln_idx) & (deleted.norm == old_set.on),
                          "left_semi").select("vuln_idx", F.lit("common").alias("kind"),
                                              F.col("norm").alias("vul_body"), F.col("abst").alias("abs_body"))
    vul_set = vul.select("vuln_idx", F.col("norm").alias("vn")).distinct()
    added = pat.where(F.col("norm") != "").join(
        vul_set, (pat.vuln_idx == vul_set.vuln_idx) & (pat.norm == vul_set.vn), "left_anti")
    pat_lines = added.select("vuln_idx", F.col("norm").alias("pat_body"), F.col("abst").alias("abs_body"))
    deps = [d.where(F.col("norm").startswith("import")).select(
        "vuln_idx", F.lit(o).alias("origin"), F.lit("import").alias("dep_key"),
        F.col("abst").alias("abs_norm_vul"), F.col("norm").alias("orig_norm_vul")) for d, o in ((vul, "vul"), (old, "old"))]
    return {
        "oss_idx": oss_idx, "vuln_cve": vuln_cve, "vuln_hash": vuln_hash, "vuln_body": body,
        "ess_lines": minus.unionByName(common), "pat_lines": pat_lines,
        "dep_lines": deps[0].unionByName(deps[1]),
    }


# --- DuckDB text of the same store ---------------------------------------------------

T3_RE2 = (r"""(?sm)(//.*?$|[{}]+)|(/\*.*?\*/)|('[^\\']*(?:\\.[^\\']*)*'|"[^\\"]*(?:\\.[^\\"]*)*"|.[^/'"]*)""")


def _norm_sql(body: str) -> str:
    t3 = T3_RE2.replace("'", "''")
    return (f"list_transform(string_split(regexp_replace({body}, '{t3}', '\\3', 'g'), chr(10)), "
            "lambda l: lower(replace(replace(replace(l, chr(13), ''), chr(9), ''), ' ', '')))")


def oracle_functions_sql(files: str = "syn_files") -> str:
    """``syn_fn``: the three forms over a files CTE (same rules as Spark)."""
    loc = r"regexp_extract_all(content, '(?m)^\s*([A-Za-z_]\w*)\s*=[^=]', 1)"
    return f"""syn_fn0 AS (
  SELECT file_id, 'f' || CAST(file_id AS VARCHAR) AS name, path, content AS body, lines AS orig,
         list_filter({loc}, lambda x, i: list_position({loc}, x) = i) AS locals
  FROM {files}),
syn_fn1 AS (
  SELECT *, list_reduce(list_filter(locals, lambda v: length(v) > 0 AND regexp_full_match(v, '\\w+')),
      lambda s, v: regexp_replace(s, '(^|\\W)' || v || '(\\W)', '\\1LVAR\\2', 'g'), body) AS abst_body
  FROM syn_fn0),
syn_fn AS (
  SELECT name || '##' || replace(path, '/', '@@') AS func_id, name, path, file_id, orig,
    CASE WHEN length(body) > 0 THEN {_norm_sql('body')} ELSE []::VARCHAR[] END AS norm,
    CASE WHEN length(body) > 0 THEN {_norm_sql('abst_body')} ELSE []::VARCHAR[] END AS abst,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir
  FROM syn_fn1),
syn_functions AS (
  SELECT *, md5(lower(translate(array_to_string(norm, ''), chr(10) || chr(13) || chr(9) || '{{}} ', ''))) AS norm_hash
  FROM syn_fn)"""


def oracle_store_sql() -> str:
    """CTEs ``oss_idx, vuln_cve, vuln_hash, vuln_body, ess_lines, pat_lines,
    dep_lines`` (needs ``syn_functions``)."""
    return """oc AS (
  SELECT c.c_nationkey AS nationkey, o.o_orderdate AS d, o.o_orderkey AS k
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
ends AS (SELECT nationkey, arg_min(k, (d, k)) AS fk, arg_max(k, (d, k)) AS lk FROM oc GROUP BY 1),
sec AS (SELECT oc.nationkey, arg_min(oc.k, (oc.d, oc.k)) AS sk FROM oc JOIN ends e
        ON oc.nationkey = e.nationkey AND oc.k <> e.fk GROUP BY 1),
vers AS (
  SELECT e.nationkey, n.n_regionkey AS regionkey, r.r_name, v.version, v.orderkey
  FROM ends e JOIN sec s ON e.nationkey = s.nationkey
  JOIN nation n ON n.n_nationkey = e.nationkey JOIN region r ON r.r_regionkey = n.n_regionkey,
  LATERAL (VALUES ('old', e.fk), ('vul', s.sk), ('pat', e.lk)) v(version, orderkey)),
vf AS (
  SELECT 'V' || lpad(CAST(v.nationkey AS VARCHAR), 2, '0') AS vuln_idx, v.nationkey, v.regionkey, v.r_name,
         v.version, f.norm, f.abst, f.norm_hash
  FROM vers v JOIN syn_functions f ON f.file_id = v.orderkey),
oss_idx AS (SELECT DISTINCT r_name AS oss, vuln_idx FROM vf),
vuln_cve AS (SELECT DISTINCT vuln_idx, 'CVE-' || CAST(regionkey + 2000 AS VARCHAR) || '-' ||
             lpad(CAST(nationkey AS VARCHAR), 4, '0') AS cve FROM vf),
vuln_hash AS (SELECT DISTINCT r_name AS oss, norm_hash AS hash FROM vf WHERE version IN ('vul', 'old')),
vuln_body AS (SELECT vuln_idx, any_value(norm) FILTER (WHERE version = 'vul') AS vul_body,
                     any_value(norm) FILTER (WHERE version = 'old') AS old_body FROM vf GROUP BY 1),
vlines AS (SELECT vuln_idx, version, unnest(norm) AS norm, unnest(abst) AS abst FROM vf),
deleted AS (SELECT * FROM vlines v WHERE version = 'vul' AND norm <> '' AND NOT EXISTS (
  SELECT 1 FROM vlines p WHERE p.version = 'pat' AND p.vuln_idx = v.vuln_idx AND p.norm = v.norm)),
ess_lines AS (
  SELECT vuln_idx, 'minus' AS kind, norm AS vul_body, abst AS abs_body FROM deleted
  UNION ALL
  SELECT vuln_idx, 'common', norm, abst FROM deleted d WHERE EXISTS (
    SELECT 1 FROM vlines o WHERE o.version = 'old' AND o.vuln_idx = d.vuln_idx AND o.norm = d.norm)),
pat_lines AS (SELECT vuln_idx, norm AS pat_body, abst AS abs_body FROM vlines p
  WHERE version = 'pat' AND norm <> '' AND NOT EXISTS (
    SELECT 1 FROM vlines v WHERE v.version = 'vul' AND v.vuln_idx = p.vuln_idx AND v.norm = p.norm)),
dep_lines AS (SELECT vuln_idx, version AS origin, 'import' AS dep_key, abst AS abs_norm_vul,
                     norm AS orig_norm_vul
  FROM vlines WHERE version IN ('vul', 'old') AND starts_with(norm, 'import'))"""
