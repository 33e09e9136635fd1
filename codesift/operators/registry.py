"""Detector registry.

A detector is a name, the languages (file extensions without the dot or
language names) it claims, and a function ``files -> matches`` returning the
``MATCH_COLUMNS``.  ``run_registered`` routes each file to the detectors
that claim its extension (a filter, no join) and unions their matches (D9).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import catalog as CAT
from . import detect as D


class DetectorRegistry:
    def __init__(self):
        self._detectors: list[tuple[str, list[str], Callable[[DataFrame], DataFrame]]] = []

    def register(self, name: str, languages: Sequence[str], fn: Callable[[DataFrame], DataFrame]) -> None:
        self._detectors.append((name, list(languages), fn))

    def supported_languages(self) -> list[str]:
        """A10: concatenated language lists in registration order."""
        return [lang for _n, langs, _f in self._detectors for lang in langs]

    def run(self, files: DataFrame, min_confidence: float = 0.7) -> DataFrame:
        """D9 over the registered detectors.  A file goes to a detector when
        its lower-cased extension is one of the detector's languages (the
        Go scanner's file filter)."""
        ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]*)$", 1))
        outs = []
        for _name, langs, fn in self._detectors:
            outs.append(fn(files.where(ext.isin(langs))))
        return D.run_detectors(outs, min_confidence)


def default_registry() -> DetectorRegistry:
    """The Go scanner's two built-in detectors."""
    reg = DetectorRegistry()

    def python(files):
        return D.scan_files_fused(files, [D.GO_LINE_GROUPS[0]], ("python",))

    def javascript(files):
        return D.scan_files_fused(files, [D.GO_LINE_GROUPS[1]], ("javascript",))

    reg.register("python", CAT.DETECTOR_LANGUAGES["python"], python)
    reg.register("javascript", CAT.DETECTOR_LANGUAGES["javascript"], javascript)
    return reg


def register_detector(registry: DetectorRegistry, name: str, languages: Sequence[str], fn) -> DetectorRegistry:
    """X1."""
    registry.register(name, languages, fn)
    return registry
