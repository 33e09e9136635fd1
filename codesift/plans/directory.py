"""The directory-scan workflow as one call (what the reference's CLI does):
read a tree, drop excluded / oversized files, run the registered detectors,
keep findings above the confidence threshold, write a report folder.

Everything runs as Spark jobs over the files; the only driver work is
planning.  Returns the findings DataFrame (lazy until the report is written).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.registry import DetectorRegistry, default_registry
from ..session import materialize
from ..sources import files as SF
from ..sources import sinks as SK


def scan_directory(spark: SparkSession, root: str, out: str | None = None, formats: Sequence[str] = ("json",),
                   exclude: Sequence[str] = (), exclude_mode: str = "basename",
                   min_confidence: float = 0.7, max_bytes: int = SF.DEFAULT_MAX_BYTES,
                   registry: DetectorRegistry | None = None, title: str = "Vulnerability Report") -> DataFrame:
    registry = registry or default_registry()
    files = SF.scan_corpus(spark, root, max_bytes=max_bytes, exclude=exclude, exclude_mode=exclude_mode)
    findings = registry.run(files.select("path", "content"), min_confidence)
    if out:
        for fmt in formats:
            if fmt == "json":
                SK.write_json(findings, f"{out.rstrip('/')}/json", title=title)
            elif fmt == "xml":
                SK.write_xml(findings, f"{out.rstrip('/')}/xml", title=title)
            else:
                raise ValueError(f"unknown report format {fmt!r}")
    return findings


def clone_scan_directory(spark: SparkSession, root: str, store_root: str, theta: float = 0.5,
                         suffixes: Sequence[str] = (".c", ".cc", ".cpp"), tags_path: str | None = None,
                         functions_out: str | None = None) -> DataFrame:
    """Job A end to end: read the C/C++ files of a tree, extract functions
    (from a ctags file when given, else by brace depth), build the three
    forms and hashes, optionally persist the function store, load the
    vulnerability store and detect vulnerable clones."""
    from pyspark.sql import functions as F

    from ..operators import clones as CL
    from ..sources import vulnstore as VS

    files = SF.scan_corpus(spark, root, max_bytes=None, suffixes=suffixes)
    if tags_path:
        tags = VS.load_tags(spark, tags_path)
        fns = CL.extract_functions(SF.to_lines(files), tags)
        ids = CL.tags_in_functions(tags)
        fns = fns.join(ids, ["path", "name", "start_line"], "left")
        forms = CL.three_forms(fns.select("name", "path", "body", "params", "dtypes", "locals"),
                               params_col=F.col("params"), dtypes_col=F.col("dtypes"), locals_col=F.col("locals"))
    else:
        fns = CL.extract_functions_braces(files)
        forms = CL.three_forms(fns.select("name", "path", "body"))
    # extracted once: the detector reads the functions three times
    if functions_out:
        SK.save_functions(forms.withColumn("repo", F.lit(root.rstrip("/").rsplit("/", 1)[-1])), functions_out)
        forms = SK.load_functions(spark, functions_out)
    else:
        forms = materialize(forms, "functions")
    return CL.detect_clones(forms, VS.load_vuln_store(spark, store_root), theta)
