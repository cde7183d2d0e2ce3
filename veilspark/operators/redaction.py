"""Redaction plans and redacted text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.geometry import range_box
from veilspark.functions.spans import after, cut_out, spans_of
from veilspark.schema import BBOX

REPLACE, BLACK_BAR, HIGHLIGHT = "replace", "black_bar", "highlight"


def stars(text: Column) -> Column:
    return F.call_function("repeat", F.lit("*"), F.greatest(F.lit(3), F.least(F.length(text), F.lit(32))))


def plan(detections: DataFrame, redaction_type: str = REPLACE, replacement: str | None = None) -> DataFrame:
    """One redaction per detection: redaction_type, replacement_text. A highlight keeps the text; ``replacement`` is
    honoured where it is given."""
    if redaction_type not in (REPLACE, BLACK_BAR, HIGHLIGHT):
        raise ValueError(f"unknown redaction type {redaction_type!r}")
    new = F.col("text") if redaction_type == HIGHLIGHT else F.lit(replacement) if replacement is not None else stars(F.col("text"))
    return detections.withColumns({"redaction_type": F.lit(redaction_type), "replacement_text": new})


def by_page(redactions: DataFrame) -> DataFrame:
    return redactions.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n_redactions"))


def by_type(redactions: DataFrame) -> DataFrame:
    return redactions.groupBy("detection_type").agg(F.count(F.lit(1)).alias("n_redactions"))


def spliced(text: Column, spans: Column) -> Column:
    """The text with array<struct<start, end, replacement>> put in, from left to right; a span that begins inside one
    already put in is covered by it and adds nothing, one that reaches beyond it is covered from where that ends."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        whole = s["start"] >= acc["pos"]
        out = F.when(whole, F.concat(acc["out"], cut_out(text, acc["pos"], s["start"]), s["replacement"])).when(s["end"] > acc["pos"], F.concat(acc["out"], F.call_function("repeat", F.lit("*"), s["end"] - acc["pos"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: F.concat(acc["out"], after(text, acc["pos"])))


def redacted_blocks(blocks: DataFrame, redactions: DataFrame) -> DataFrame:
    """Blocks with redacted_text and n_redactions."""
    at = redactions.groupBy("doc_id", "page_number", "block_ord").agg(F.collect_list(F.struct("start", "end", F.col("replacement_text").alias("replacement"))).alias("spans_"))
    joined = blocks.join(at, ["doc_id", "page_number", "block_ord"], "left")
    return joined.withColumns({"redacted_text": F.when(F.col("spans_").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("spans_"))), "n_redactions": F.coalesce(F.size("spans_"), F.lit(0)).cast("bigint")}).drop("spans_")


JOBS = f"array<struct<bbox:{BBOX},replacement_text:string>>"


def _united(pages: pd.Series) -> pd.Series:
    def meet(a: dict, b: dict) -> bool:
        """Whether two boxes share an area; an edge is none."""
        return min(a["x1"], b["x1"]) > max(a["x0"], b["x0"]) and min(a["y1"], b["y1"]) > max(a["y0"], b["y0"])

    def page(jobs: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for new in jobs:
            box, text, k = dict(new["bbox"]), new["replacement_text"], 0
            while k < len(kept):
                other = kept[k]["bbox"]
                if not meet(box, other):
                    k += 1
                    continue
                if other["x1"] - other["x0"] > box["x1"] - box["x0"]:
                    text = kept[k]["replacement_text"]
                box = {c: (min if c in ("x0", "y0") else max)(box[c], other[c]) for c in box}
                del kept[k]
                k = 0  # the larger box may meet those passed
            kept.append({"bbox": box, "replacement_text": text})
        return kept

    return pages.map(page)


def merged_jobs(redactions: DataFrame) -> DataFrame:
    """Boxes of one page and type that share an area become one, until none do. They are taken in the entries' order (start,
    type, block, detector); of two that become one the wider's replacement stays, the newer's where they are as wide. Which
    boxes end up together depends on the boxes before, so a page's boxes go through a loop; only pages with two or more."""
    order = F.struct("start", "detection_type", "block_ord", "detector_ord", "pattern_ord", "end", F.struct("bbox", "replacement_text").alias("j"))
    pages = redactions.groupBy("doc_id", "page_number", "redaction_type").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["j"]).alias("jobs"))
    one = F.size("jobs") == 1
    parts = pages.filter(one).unionByName(pages.filter(~one).withColumn("jobs", F.pandas_udf(_united, JOBS)("jobs")))
    return parts.select("doc_id", "page_number", "redaction_type", F.explode("jobs").alias("j")).select("doc_id", "page_number", "redaction_type", "j.*")


def refined_boxes(redactions: DataFrame, blocks: DataFrame, slack: float = 2.0) -> DataFrame:
    """A box for each redaction that fits its text: the occurrences of the text within its own box (give or take
    ``slack``), else the page's occurrence whose centre is nearest, else its own box. Boxes that are equal to a tenth of a
    point stand once on a page. ``blocks`` needs words with boxes."""
    key = ["doc_id", "page_number", "block_ord", "start", "end", "text"]
    r = redactions.select(*key, "redaction_type", "replacement_text", F.col("bbox").alias("own"))
    quoted = F.concat(F.lit(r"\Q"), F.col("text"), F.lit(r"\E"))
    page = blocks.filter(F.col("block_type") == "text").select("doc_id", "page_number", F.col("text").alias("t"), F.col("bbox").alias("b"), "words")
    hits = r.join(page, ["doc_id", "page_number"]).filter(F.col("t").contains(F.col("text"))).withColumn("s", F.explode(spans_of(F.col("t"), quoted)))
    hits = hits.withColumn("box", range_box(F.col("t"), F.col("words"), F.col("b"), F.col("s.start"), F.col("s.end")))
    box, own = F.col("box"), F.col("own")
    inside = (box["x0"] >= own["x0"] - slack) & (box["y0"] >= own["y0"] - slack) & (box["x1"] <= own["x1"] + slack) & (box["y1"] <= own["y1"] + slack)
    middle = lambda b, a, z: (b[a] + b[z]) / 2
    far = F.pow(middle(box, "x0", "x1") - middle(own, "x0", "x1"), 2) + F.pow(middle(box, "y0", "y1") - middle(own, "y0", "y1"), 2)
    found = hits.groupBy(*key).agg(F.collect_list(F.when(inside, box)).alias("in_"), F.min(F.struct(far.alias("far"), box.alias("box")))["box"].alias("near"))
    chosen = F.when(F.col("near").isNull(), F.array("own")).when(F.size("in_") > 0, F.col("in_")).otherwise(F.array("near"))
    out = r.join(found, key, "left").select("doc_id", "page_number", "redaction_type", "replacement_text", F.explode(chosen).alias("bbox"))
    tenth = lambda c: F.round(F.col("bbox")[c], 1).alias("r" + c)
    return out.select("*", *(tenth(c) for c in ("x0", "y0", "x1", "y1"))).dropDuplicates(["doc_id", "page_number", "rx0", "ry0", "rx1", "ry1"]).drop("rx0", "ry0", "rx1", "ry1")
