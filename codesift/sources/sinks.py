"""Report sinks (S11 JSON, S12 XML) and the function store.

A report is written as a folder, never funnelled through one task:
``results/`` holds one document per file (path + its matches), written in
parallel; ``summary/`` holds the one-row summary.  Readers that want the
single upstream document concatenate the two.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report as R
from ..session import materialize

XML_DOCUMENTS = 20_000  # documents of one XML file: such a file is read by one task
XML_FILES = ("_path string, match array<struct<_id: string, name: string, description: string, severity: string, "
             "lineNumber: int, matchedCode: string, confidence: double>>")


def _report_parts(matches: DataFrame, title: str, timestamp: str | None, signatures: DataFrame | None):
    """The per-file documents, written once, and the summary taken from them:
    the matches (and so the corpus) are evaluated once per report."""
    ts = timestamp or datetime.datetime.now(datetime.timezone.utc).isoformat()
    if signatures is not None:
        matches = matches.join(signatures.select("sig_id", "description"), "sig_id", "left")
    else:
        matches = matches.withColumn("description", F.lit(None).cast("string"))
    per_file = materialize(R.per_file_report(matches), "report")
    flat = per_file.select("path", F.explode("matches").alias("m")).select("path", "m.name", "m.severity")
    summary = R.go_summary(flat).select(F.lit(title).alias("title"), F.lit(ts).alias("timestamp"), "*")
    return per_file, summary


def write_json(matches: DataFrame, path: str, title: str = "Vulnerability Report",
               timestamp: str | None = None, signatures: DataFrame | None = None) -> None:
    """S11.  ``signatures(sig_id, description)`` adds the descriptions."""
    per_file, summary = _report_parts(matches, title, timestamp, signatures)
    per_file.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_xml(matches: DataFrame, path: str, title: str = "Vulnerability Report",
              timestamp: str | None = None, signatures: DataFrame | None = None) -> None:
    """``<report><file path=..><match id=..>...`` via Spark's XML source.
    Attributes use the ``_`` prefix convention of the XML data source.
    ``signatures(sig_id, description)`` adds the descriptions."""
    per_file, summary = _report_parts(matches, title, timestamp, signatures)
    files = per_file.select(
        F.col("path").alias("_path"),
        F.transform("matches", lambda m: F.struct(
            m["sig_id"].alias("_id"), m["name"].alias("name"), m["description"].alias("description"),
            m["severity"].alias("severity"),
            m["line_start"].alias("lineNumber"), m["matched_code"].alias("matchedCode"),
            m["confidence"].alias("confidence"))).alias("match"))
    (files.write.mode("overwrite").format("xml").option("rootTag", "results").option("rowTag", "file")
     .option("maxRecordsPerFile", XML_DOCUMENTS).save(f"{path}/results"))
    (summary.select("title", "timestamp", F.struct(
        F.col("total_files").alias("_totalFiles"), F.col("high").alias("_high"),
        F.col("medium").alias("_medium"), F.col("low").alias("_low")).alias("summary"))
     .write.mode("overwrite").format("xml").option("rootTag", "report").option("rowTag", "header")
     .save(f"{path}/summary"))


def read_json_report(spark, path: str) -> DataFrame:
    return spark.read.json(f"{path}/results")


def read_xml_report(spark, path: str) -> DataFrame:
    return spark.read.format("xml").schema(XML_FILES).option("rowTag", "file").load(f"{path}/results")


def save_functions(functions: DataFrame, path: str) -> None:
    """Persist target functions, partitioned by repository/dir."""
    functions.write.mode("overwrite").partitionBy("repo").parquet(path)


def load_functions(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
