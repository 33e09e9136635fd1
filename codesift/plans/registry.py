"""Registry of driver queries: name -> (spark, sf_dir) -> DataFrame, and
name -> DuckDB oracle SQL.  Names follow the operator they exercise."""

from __future__ import annotations

from . import scans as S

QUERIES = {}
ORACLES = {}


def _register(module, names):
    for name in names:
        QUERIES[name] = getattr(module, f"q_{name}")
        sql = getattr(module, f"sql_{name}", None)
        if sql is not None:
            ORACLES[name] = sql


_register(S, [
    "scan_python_lines", "scan_javascript_lines", "block_checks_python", "block_checks_javascript",
    "go_directory_scan", "severity_summary", "go_summary", "totals", "type_counts", "top_types",
    "top_files", "severity_distribution", "confidence_histogram", "per_file_report", "file_list",
    "severity_normalized", "signature_scan_all", "signature_file_scan", "report_rows", "go_signature_scan", "registered_detectors_scan",
    "catalogue_lines", "catalogue_first", "finding_references",
])

from . import security as K  # noqa: E402

_register(K, ["security_checks_python", "sensitive_data_documents", "sensitive_data_pages",
              "security_full_check", "security_full_check_all", "security_full_check_files"])

from . import clone_jobs as CJ  # noqa: E402

_register(CJ, ["function_forms", "exact_clone_groups", "document_line_hashes", "clone_hash_hits",
               "clone_reused_vulns", "clone_reduced_functions", "clone_containment", "clone_jaccard",
               "benchmark_containment", "store_corpus_line_intersect", "store_corpus_line_union",
               "vuln_store_rules", "clone_findings", "clone_rule_checks", "text_forms_lines",
               "brace_functions", "clone_findings_by_cve", "clone_findings_c", "abstract_forms"])

from . import symbol_jobs as SJ  # noqa: E402

_register(SJ, ["call_sites", "parse_errors", "symbols", "context_counts", "file_complexity", "exact_calls",
               "call_name_matches", "similar_calls", "sandbox_escape_calls", "js_call_sites",
               "symbols_files", "context_counts_files", "complexity_files", "input_checks_files", "similar_names", "go_call_sites",
               "go_call_checks", "analyzer_symbols"])

from . import first_match as FM  # noqa: E402

_register(FM, ["first_match_scan", "first_match_fix_similarity", "first_match_context", "semantic_hashes",
               "semantic_clone_groups"])

from . import lifecycle as LC  # noqa: E402

_register(LC, ["corpus_files", "resolve_language", "exclude_globs_basename", "exclude_globs_path",
               "inline_batch_accepted", "inline_batch_rejected", "json_report", "xml_report", "function_store",
               "vuln_store_files", "tag_functions", "incremental_scan", "stream_scan", "incremental_versions",
               "stream_distinct_scan", "decoded_files", "supported_languages", "function_store_arrays"])
