"""Rollups over ``matches``.

Every rollup is a partial (map-side) aggregation followed by one shuffle of
already-aggregated rows; top-k uses ``orderBy().limit()`` which Spark plans as
``TakeOrderedAndProject`` (a per-partition top-k, then a merge of k rows per
partition) — no global sort.  Fixed key tables are tiny literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PY_SEVERITY_KEYS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
GO_SEVERITY_KEYS = ["high", "medium", "low"]


def severity_summary(matches: DataFrame, keys=PY_SEVERITY_KEYS) -> DataFrame:
    """A1 (Python form): count per severity, fixed keys present at 0, plus
    any other severity seen."""
    spark = matches.sparkSession
    zeros = spark.createDataFrame([(k, 0) for k in keys], "severity string, n bigint")
    counts = matches.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(zeros).groupBy("severity").agg(F.sum("n").cast("bigint").alias("n"))


def go_summary(matches: DataFrame) -> DataFrame:
    """A1+A2+A3 (Go form): one row ``total_files, high, medium, low,
    vulnerabilities map<name, count>``.  ``total_files`` counts files with
    results, as the Go result map only holds those."""
    # one scan of the matches: counts per path, per severity and per name are
    # grouping sets, combined before the shuffle; grouping_id names the set
    sets = matches.groupingSets([["path"], ["severity"], ["name"]], "path", "severity", "name").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("of"))
    per_path, per_severity, per_name = (F.col("of") == g for g in (0b011, 0b101, 0b110))
    of_severity = lambda s: F.coalesce(
        F.sum(F.when(per_severity & (F.col("severity") == s), F.col("n"))), F.lit(0)).cast("bigint").alias(s)
    names = F.collect_list(F.when(per_name & F.col("name").isNotNull(), F.struct("name", "n")))
    return sets.agg(F.count_if(per_path & F.col("path").isNotNull()).alias("total_files"),
                    *[of_severity(s) for s in GO_SEVERITY_KEYS],
                    F.map_from_entries(names).alias("vulnerabilities"))


def totals(matches: DataFrame) -> DataFrame:
    """A2: total matches and distinct files."""
    return matches.agg(F.count(F.lit(1)).alias("total_vulnerabilities"),
                       F.countDistinct("path").alias("total_files"))


def type_counts(matches: DataFrame) -> DataFrame:
    """A3: matches per signature name."""
    return matches.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def top_types(matches: DataFrame, n: int = 10) -> DataFrame:
    """A4: top-n signature names by count (name breaks ties)."""
    return type_counts(matches).orderBy(F.desc("n"), F.asc("name")).limit(n)


def top_files(matches: DataFrame, n: int = 10) -> DataFrame:
    """A5: top-n files by match count (path breaks ties)."""
    return (matches.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("path")).limit(n))


def severity_distribution(matches: DataFrame) -> DataFrame:
    """A6."""
    return matches.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(matches: DataFrame, width: float = 0.05) -> DataFrame:
    """``bucket = floor(confidence / width)`` with its bounds.  The ratio is
    rounded to 9 places first so a confidence sitting on a bucket edge (e.g.
    0.9500000000000001) lands in the same bucket as its exact value."""
    b = F.floor(F.round(F.col("confidence") / F.lit(width), 9)).cast("bigint")
    return (matches.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
            .select("bucket", (F.col("bucket") * F.lit(width)).alias("lo"),
                    ((F.col("bucket") + 1) * F.lit(width)).alias("hi"), "n"))


def per_file_report(matches: DataFrame) -> DataFrame:
    """``path -> ordered list of matches`` with the count; matches keep a
    ``description`` if they have one.

    A group is one file's matches, bounded by the file-size limit of the
    corpus scan (S4), never by corpus size.
    """
    fields = ["line_start", "sig_id", "line_end", "name", "severity", "matched_code", "confidence"]
    m = F.struct(*fields, *[c for c in ("description",) if c in matches.columns])
    return matches.groupBy("path").agg(F.count(F.lit(1)).alias("n"),
                                       F.sort_array(F.collect_list(m)).alias("matches"))


def file_list(matches: DataFrame) -> DataFrame:
    """Sorted distinct files."""
    return matches.select("path").distinct().orderBy("path")


def report_rows(matches: DataFrame, signatures: DataFrame) -> DataFrame:
    """Match + signature fields flattened for rendering.  Spark
    broadcasts the signature table if its size allows it."""
    sig = signatures.select("sig_id", "description", "cwe_id", "cve_id")
    return matches.join(sig, "sig_id", "left").select(
        F.col("sig_id").alias("id"), "name", "description", "severity", "cwe_id", "cve_id",
        F.col("path").alias("file"), "line_start", "line_end", "matched_code", "confidence")


# --- U1 -------------------------------------------------------------------------

def line_union(a: DataFrame, b: DataFrame, col: str = "line") -> DataFrame:
    return a.select(col).union(b.select(col)).distinct()


def line_intersect(a: DataFrame, b: DataFrame, col: str = "line") -> DataFrame:
    return a.select(col).intersect(b.select(col))
