"""Detection over a stream of documents. Beyond batch: detectors that need no other block run as a stateless stream;
whole documents come in one row, so document-wide rules run in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators import detectors as d
from veilspark.operators.registry import Registry, default_registry
from veilspark.sources.text import line_blocks


def scan_stream(docs: DataFrame, detector: d.Detector) -> DataFrame:
    """Detections of one detector, every occurrence, as a streaming frame (doc_id, text)."""
    return d.scan(line_blocks(docs), detector, dedupe="none")


def counts_by_window(detections: DataFrame, time: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Detections of each type in each time window; late rows are waited for."""
    return detections.withWatermark(time, late).groupBy(F.window(time, size), "detection_type").agg(F.count(F.lit(1)).alias("n_detections"))


def run_batches(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, registry: Registry | None = None) -> StreamingQuery:
    """Every micro-batch of whole documents through all detectors, into ``sink`` (batch frame, batch number)."""
    chosen = registry or default_registry()

    def each(batch: DataFrame, number: int) -> None:
        sink(chosen.run(line_blocks(batch)), number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
