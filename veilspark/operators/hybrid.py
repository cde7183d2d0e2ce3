"""Native and OCR blocks of the same pages together: OCR text fills what native text leaves open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.geometry import area, shared_area

DEFAULT_PAGE = (595.0, 842.0)


def by_place(rows: DataFrame) -> DataFrame:
    """page_number counted from 1 over the document's pages in order: pages of two parses pair by place, whatever numbers
    they bear."""
    order = Window.partitionBy("doc_id").orderBy("page_number")
    return rows.withColumn("page_number", F.dense_rank().over(order))


def pages(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """doc_id, page_number, width, height: native's, else OCR's, else A4. Pages pair by their place."""
    o = by_place(ocr).select("doc_id", "page_number", F.col("width").alias("ow"), F.col("height").alias("oh"))
    both = by_place(native).join(o, ["doc_id", "page_number"], "full")
    return both.select("doc_id", "page_number", F.coalesce("width", "ow", F.lit(DEFAULT_PAGE[0])).alias("width"), F.coalesce("height", "oh", F.lit(DEFAULT_PAGE[1])).alias("height"))


def merge(native: DataFrame, ocr: DataFrame, smaller_box: bool = False) -> DataFrame:
    """All native blocks, and the OCR text blocks whose overlap with every native text block of the page in the same place is
    half of that block's area or less (of the smaller box's with ``smaller_box``); provenance says where each is from.
    page_number is the place. A page counts if it has a block of any kind."""
    native, ocr = by_place(native), by_place(ocr)
    n = native.filter(F.col("block_type") == "text").select("doc_id", "page_number", F.col("bbox").alias("native_box"))
    base = F.least(area(F.col("bbox")), area(F.col("native_box"))) if smaller_box else area(F.col("native_box"))
    covered = (F.col("ocr.doc_id") == F.col("n.doc_id")) & (F.col("ocr.page_number") == F.col("n.page_number")) & F.coalesce(shared_area(F.col("bbox"), F.col("native_box")) > base * 0.5, F.lit(False))
    filled = ocr.filter(F.col("block_type") == "text").alias("ocr").join(n.alias("n"), covered, "left_anti")
    columns = native.columns
    return native.select(*columns, F.lit("native").alias("provenance")).unionByName(filled.select(*columns, F.lit("ocr").alias("provenance")))


def summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy("provenance").agg(F.count(F.lit(1)).alias("n_blocks"))
