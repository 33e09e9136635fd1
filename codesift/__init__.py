"""codesift: a Spark-native engine for finding known-vulnerable code in large corpora.

Everything is a DataFrame -> DataFrame function:

* ``sources``   – corpus, signatures, vulnerability stores, tags, sinks
* ``functions`` – column expressions (normalisation, regex dialects, confidence,
  match positions, LCS, semantic hash)
* ``operators`` – detectors, clone joins, symbol tables, security checks, rollups
* ``plans``     – composed jobs over the driver tables (synthetic corpus, store)
* ``streaming`` – incremental and Structured Streaming scans
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so workers need
# no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.checks import full_check, security_check  # noqa: E402
from .operators.clones import detect_clones  # noqa: E402
from .operators.detect import detect_all, detect_first, detect_lines, go_directory_scan  # noqa: E402
from .operators.registry import DetectorRegistry, default_registry  # noqa: E402
from .plans.directory import clone_scan_directory, scan_directory  # noqa: E402
from .session import local_session  # noqa: E402
from .sources.files import scan_corpus  # noqa: E402
from .sources.vulnstore import load_tags, load_vuln_store  # noqa: E402

__all__ = ["scan_directory", "clone_scan_directory", "scan_corpus", "load_vuln_store", "load_tags",
           "detect_lines", "detect_all", "detect_first", "go_directory_scan", "detect_clones",
           "security_check", "full_check", "DetectorRegistry", "default_registry", "local_session"]
