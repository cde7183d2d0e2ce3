"""A registry of detectors, and the run of several of them as one plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators import detectors as d
from veilspark.operators.names import scan_names
from veilspark.schema import DETECTIONS

Scan = Callable[[DataFrame, int, bool], DataFrame]


class Registry:
    """Detectors by name, in order of registration; a name that comes again replaces the one before."""

    def __init__(self) -> None:
        self._scans: dict[str, d.Detector | Scan] = {}

    def register(self, detector: d.Detector | tuple[str, Scan]) -> Registry:
        """A pattern detector, or a name with a function (blocks, detector_ord, values_only) -> detections."""
        name, scan = detector if isinstance(detector, tuple) else (detector.name, detector)
        if not name:
            raise ValueError("a detector needs a name")
        self._scans[name] = scan
        return self

    def unregister(self, name: str) -> Registry:
        self._scans.pop(name)
        return self

    @property
    def names(self) -> list[str]:
        return list(self._scans)

    def run(self, blocks: DataFrame, names: list[str] | None = None, values_only: bool = False, dedupe: str = "document") -> DataFrame:
        """Detections of all detectors, or of those named; what isn't named never enters the plan. Pattern detectors share
        their passes over the blocks."""
        chosen = self.names if names is None else names
        if unknown := [n for n in chosen if n not in self._scans]:
            raise ValueError(f"unknown detectors: {', '.join(unknown)}; known are {', '.join(self.names)}")
        wanted = [(k, self._scans[n]) for k, n in enumerate(self.names) if n in chosen]
        patterns = [(k, x) for k, x in wanted if isinstance(x, d.Detector)]
        parts = [d.scan_many(blocks, patterns, values_only, dedupe)] if patterns else []
        parts += [d.aligned(x(blocks, k, values_only)) for k, x in wanted if not isinstance(x, d.Detector)]
        if not parts:
            return blocks.sparkSession.createDataFrame([], DETECTIONS)
        return reduce(DataFrame.unionByName, parts)

    def timed(self, blocks: DataFrame, names: list[str] | None = None, values_only: bool = False) -> DataFrame:
        """detector_name, n_detections, duration_ms: each detector run by itself, one after the other, by the wall clock."""
        rows = []
        for name in self.names if names is None else names:
            began = time.perf_counter()
            n = self.run(blocks, [name], values_only).count()
            rows.append((name, n, (time.perf_counter() - began) * 1000))
        return blocks.sparkSession.createDataFrame(rows, "detector_name string, n_detections bigint, duration_ms double")


def default_registry(names: bool = True) -> Registry:
    out = Registry()
    for x in (d.PAN, d.AADHAAR, d.EMAIL, d.PHONE, d.UPI, d.IFSC, d.ACCOUNT):
        out.register(x)
    return out.register(("name", scan_names)) if names else out


def run_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("detector_name").agg(F.count(F.lit(1)).alias("n_detections"))


def with_ids(detections: DataFrame) -> DataFrame:
    """detection_id: the first 12 hex digits of the SHA-256 of page|type|start|end|text."""
    key = F.concat_ws("|", F.col("page_number").cast("string"), "detection_type", F.col("start").cast("string"), F.col("end").cast("string"), "text")
    return detections.withColumn("detection_id", F.substring(F.sha2(key, 256), 1, 12))
