"""Semantic matching for the first-match detector.

J15 needs ``difflib.SequenceMatcher`` ratios, which Spark has no function
for.  The best ratio is computed per *distinct* (signature, snippet) by a
``mapInPandas`` helper inside the tasks, then joined back: a snippet repeated
across the corpus is compared once, which replaces the upstream in-process
cache (keyed on text, not on semantic hash, so results do not depend on scan
order).
"""

from __future__ import annotations

import difflib
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX


def _best_ratio(snippet: str, fixes, floor: float):
    """Best ``SequenceMatcher`` ratio above ``floor`` (else None).  The cheap
    upper bounds ``real_quick_ratio`` >= ``quick_ratio`` >= ``ratio`` skip
    pairs that cannot beat ``floor`` — exact for the result, which only
    depends on ratios above it."""
    best = None
    for fix in fixes:
        sm = difflib.SequenceMatcher(None, snippet or "", fix or "")
        if sm.real_quick_ratio() <= floor or sm.quick_ratio() <= floor:
            continue
        r = sm.ratio()
        if r > floor and (best is None or r > best):
            best = r
    return best


def _best_ratios_with(floor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = [_best_ratio(s, [] if f is None else list(f), floor)
                    for s, f in zip(pdf["snippet"], pdf["fixes"])]
            yield pd.DataFrame({"sig_id": pdf["sig_id"], "snippet": pdf["snippet"], "best": best})
    return run


def sequence_ratio(pairs: DataFrame, floor: float = 0.0) -> DataFrame:
    """``pairs(sig_id, snippet, fixes array)`` -> ``sig_id, snippet, best``:
    the best ``difflib`` ratio of the snippet against the signature's fix
    patterns, when it exceeds ``floor`` (null otherwise)."""
    return pairs.select("sig_id", "snippet", "fixes").mapInPandas(
        _best_ratios_with(floor), "sig_id string, snippet string, best double")


def fix_similarity(matches: DataFrame, signatures: DataFrame, weight: float = 0.8,
                   base: float = 0.5) -> DataFrame:
    """``confidence = max(base, weight * max_fix ratio(snippet, fix))``.

    ``matches`` from ``detect_first`` (``matched_code`` is the snippet);
    ``signatures`` give each signature's ``fix_patterns`` (a catalogue,
    broadcast).  Ratios are computed once per distinct (signature, snippet)
    in Arrow batches and joined back: the matches are read twice (distinct
    snippets, join back), a repeated snippet is compared once.
    """
    fixes = signatures.select("sig_id", F.col("fix_patterns").alias("fixes"))
    snippets = matches.select("sig_id", F.col("matched_code").alias("snippet")).distinct()
    # a ratio only matters when weight * ratio > base
    best = sequence_ratio(snippets.join(F.broadcast(fixes), "sig_id", "left"), floor=base / weight)
    out = matches.join(best, (matches.sig_id == best.sig_id) & (matches.matched_code == best.snippet), "left") \
        .drop(best.sig_id).drop("snippet")
    conf = F.greatest(F.lit(base), F.coalesce(F.col("best") * F.lit(weight), F.lit(base)))
    return out.withColumn("confidence", conf).drop("best")


def semantic_hashes(df: DataFrame, col: str = "content") -> DataFrame:
    """T8 as a column: ``semantic_hash`` of each row's code."""
    return df.withColumn("semantic_hash", TX.semantic_hash(F.col(col)))
