"""Boxes as structs: overlap, IoU, unions, and the box of a range of characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:  # noqa: ANN001
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*(lit(v).cast("double").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def shared_area(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - shared_area(a, b)
    return F.when(union > 0, shared_area(a, b) / union).otherwise(F.lit(0.0))


def touch(a: Column, b: Column) -> Column:
    """Boxes that share a point; edges count."""
    return ~((a["x1"] < b["x0"]) | (b["x1"] < a["x0"]) | (a["y1"] < b["y0"]) | (b["y1"] < a["y0"]))


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def to_pixels(b: Column, dpi: float = 144.0) -> Column:
    s = F.lit(dpi / 72.0)
    return box(b["x0"] * s, b["y0"] * s, b["x1"] * s, b["y1"] * s)


def range_box(text: Column, words: Column, block_box: Column, start: Column, end: Column, edges: bool = False) -> Column:
    """The box of text[start:end] from the boxes of the words, clipped in x where a word is only partly inside; the
    block's own box where no word is met. Words are located one after the other from a cursor. A partly covered word is
    cut in proportion to its characters or, with ``edges``, at its own character edges (field ``edges``) where it has them."""
    none = F.lit(None).cast("double")
    zero = F.struct(F.lit(0).alias("pos"), none.alias("x0"), none.alias("y0"), none.alias("x1"), none.alias("y1"))

    def locate(acc: Column, w: Column) -> Column:
        found = F.call_function("locate", w["text"], text, acc["pos"] + 1) - 1
        at = F.when(found >= 0, found).otherwise(acc["pos"])
        size = F.length(w["text"])
        stop = at + size
        a, b = F.greatest(at, start), F.least(stop, end)
        per = (w["bbox"]["x1"] - w["bbox"]["x0"]) / F.greatest(size, F.lit(1))
        x0, x1 = w["bbox"]["x0"] + (a - at) * per, w["bbox"]["x0"] + (b - at) * per
        if edges:
            known = F.coalesce(F.size(w["edges"]) == size + 1, F.lit(False))
            x0, x1 = (F.when(known, F.get(w["edges"], i)).otherwise(x) for i, x in ((a - at, x0), (b - at, x1)))
        hit = a < b
        pick = lambda f, old, new: F.when(hit, F.coalesce(f(old, new), new)).otherwise(old)
        return F.struct(stop.alias("pos"), pick(F.least, acc["x0"], x0).alias("x0"), pick(F.least, acc["y0"], w["bbox"]["y0"]).alias("y0"), pick(F.greatest, acc["x1"], x1).alias("x1"), pick(F.greatest, acc["y1"], w["bbox"]["y1"]).alias("y1"))

    return F.aggregate(words, zero, locate, lambda acc: F.when(acc["x0"].isNull(), block_box).otherwise(box(acc["x0"], acc["y0"], acc["x1"], acc["y1"])))


def words_with_boxes(text: Column, bbox: Column) -> Column:
    """array<struct<text, bbox>>: the words of a span, x in proportion to their characters."""
    from veilspark.functions.spans import spans_of

    per = (bbox["x1"] - bbox["x0"]) / F.greatest(F.length(text), F.lit(1))
    return F.transform(spans_of(text, r"\S+"), lambda s: F.struct(s["value"].alias("text"), box(bbox["x0"] + s["start"] * per, bbox["y0"], bbox["x0"] + s["end"] * per, bbox["y1"]).alias("bbox")))


def without_twins(words: Column) -> Column:
    """The words, without those that have the text of an earlier kept one and overlap it by more than half (IoU)."""
    twin = lambda a, w: F.exists(a, lambda k: (k["text"] == w["text"]) & (iou(k["bbox"], w["bbox"]) > 0.5))
    return F.aggregate(words, F.slice(words, 1, 0), lambda a, w: F.when(twin(a, w), a).otherwise(F.concat(a, F.array(w))))
