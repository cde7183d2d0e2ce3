"""Fusion: overlapping detections of one type on one page become one, the better tier or confidence winning.

An ordered fold over each (document, page, type): a detection is compared with the last one kept only, so it is a fold and not
gaps and islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.geometry import iou
from veilspark.functions.lexicon import TIER_OF, TIERS


def priority(name: Column) -> Column:
    out = F.lit(TIERS["heuristic"])
    for detector, tier in TIER_OF.items():
        out = F.when(name == detector, F.lit(TIERS[tier])).otherwise(out)
    return out


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"]) & (iou(a["bbox"], b["bbox"]) > 0.5)


def _folded(detections: DataFrame) -> DataFrame:
    """doc_id, page_number, detection_type, out: struct(kept: array, log: array)."""
    names = [c for c in detections.columns if c not in ("doc_id", "page_number", "detection_type")]
    row = F.struct(F.col("start").alias("k1"), (-priority(F.col("detector_name"))).alias("k2"), (-F.col("confidence")).alias("k3"), F.col("detector_ord").alias("k4"), F.col("block_ord").alias("k5"), F.col("pattern_ord").alias("k6"), F.struct(priority(F.col("detector_name")).alias("priority"), *names).alias("d"))
    grouped = detections.groupBy("doc_id", "page_number", "detection_type").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["d"]).alias("all"))

    def merge(a: Column, b: Column) -> tuple[Column, Column]:
        first = (a["priority"] > b["priority"]) | ((a["priority"] == b["priority"]) & (a["confidence"] >= b["confidence"]))
        win, lose = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
        return win, lose

    def with_reasons(w: Column, lose: Column) -> Column:
        more = F.concat(w["reasons"], F.filter(lose["reasons"], lambda r: ~F.array_contains(w["reasons"], r)))
        return F.struct(*(more.alias(c) if c == "reasons" else w[c].alias(c) for c in ["priority", *names]))

    def why(w: Column, lose: Column) -> Column:
        pair = F.concat(w["detector_name"], F.lit(">"), lose["detector_name"], F.lit(")"))
        return F.when(w["priority"] > lose["priority"], F.concat(F.lit("higher priority tier ("), pair)).when(lose["priority"] > w["priority"], F.concat(F.lit("lower priority tier ("), lose["detector_name"], F.lit(">"), w["detector_name"], F.lit(")"))).otherwise(F.concat(F.lit("higher confidence ("), F.format_string("%.2f", w["confidence"]), F.lit(">"), F.format_string("%.2f", lose["confidence"]), F.lit(")")))

    entry = lambda w, lose: F.struct(w["text"].alias("kept_text"), w["start"].alias("kept_start"), w["end"].alias("kept_end"), w["detector_name"].alias("kept_by"), lose["text"].alias("merged_text"), lose["start"].alias("merged_start"), lose["end"].alias("merged_end"), lose["detector_name"].alias("merged_by"), why(w, lose).alias("reason"))
    first = F.get(F.col("all"), F.lit(0))
    zero = F.struct(F.slice("all", 1, 0).alias("kept"), F.slice(F.array(entry(first, first)), 1, 0).alias("log"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["kept"], F.lit(-1))
        hit = last.isNotNull() & F.coalesce(_overlap(last, x), F.lit(False))
        w, lose = merge(last, x)
        full = with_reasons(w, lose)
        kept = F.when(hit, F.concat(F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0))), F.array(full))).otherwise(F.concat(acc["kept"], F.array(x)))
        return F.struct(kept.alias("kept"), F.when(hit, F.concat(acc["log"], F.array(entry(w, lose)))).otherwise(acc["log"]).alias("log"))

    return grouped.select("doc_id", "page_number", "detection_type", F.aggregate(F.col("all"), zero, step).alias("out"))


def fuse(detections: DataFrame) -> DataFrame:
    """The fused detections, with the columns they came with."""
    out = _folded(detections).select("doc_id", "page_number", "detection_type", F.explode("out.kept").alias("d")).select("doc_id", "page_number", "detection_type", "d.*")
    return out.select(*detections.columns)


def merge_log(detections: DataFrame) -> DataFrame:
    """Every merge: what was kept, what went into it, and why."""
    return _folded(detections).select("doc_id", "page_number", "detection_type", F.posexplode("out.log").alias("log_ord", "d")).select("doc_id", "page_number", "detection_type", "log_ord", "d.*")
