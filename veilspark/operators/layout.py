"""Page layout: headers, footers, page numbers, tables, images, paragraphs, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.geometry import box
from veilspark.operators.quality import diagnose

MARGIN, GAP, NUMBER_CHARS = 0.10, 15.0, 10


def classified(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with element_type; body text is "paragraph"."""
    b = blocks.join(pages.select("doc_id", "page_number", "height"), ["doc_id", "page_number"])
    middle = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    plain = F.trim("text")
    kind = (
        F.when(F.col("block_type").isin("table", "image"), F.col("block_type"))
        .when(middle > F.col("height") * (1 - MARGIN), F.when(plain.rlike("^[0-9]+$") & (F.length(plain) <= NUMBER_CHARS), "page_number").otherwise("footer"))
        .when(middle < F.col("height") * MARGIN, "header")
        .otherwise("paragraph")
    )
    return b.withColumn("element_type", kind).drop("height")


def paragraphs(kinds: DataFrame) -> DataFrame:
    """Body blocks by descending page: a gap of 15 points or more begins a new paragraph."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("bbox.y0", "bbox.x0", "block_ord")
    body = kinds.filter(F.col("element_type") == "paragraph")
    new = F.coalesce(F.col("bbox.y0") - F.lag("bbox.y1").over(order) >= GAP, F.lit(True)).cast("int")
    marked = body.withColumns({"new": new, "place": F.row_number().over(order)}).withColumn("para", F.sum("new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    return marked.groupBy("doc_id", "page_number", "para").agg(box(F.min("bbox.x0"), F.min("bbox.y0"), F.max("bbox.x1"), F.max("bbox.y1")).alias("bbox"), text.alias("text"), F.count(F.lit(1)).alias("n_blocks")).withColumn("element_type", F.lit("paragraph"))


def elements(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """All elements with reading_order from 0: by y0 and x0, other elements before paragraphs where these are equal."""
    kinds = classified(blocks, pages)
    rest = kinds.filter(F.col("element_type") != "paragraph").select("doc_id", "page_number", "element_type", "bbox", F.when(F.col("block_type") == "text", F.col("text")).otherwise("").alias("text"), F.lit(1).cast("bigint").alias("n_blocks"), F.lit(0).alias("late"), F.col("block_ord").cast("bigint").alias("place"))
    body = paragraphs(kinds).select("doc_id", "page_number", "element_type", "bbox", "text", "n_blocks", F.lit(1).alias("late"), F.col("para").cast("bigint").alias("place"))
    order = Window.partitionBy("doc_id", "page_number").orderBy("bbox.y0", "bbox.x0", "late", "place")
    return rest.unionByName(body).withColumn("reading_order", F.row_number().over(order) - 1).drop("late", "place")


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "page_number", "element_type").agg(F.count(F.lit(1)).alias("n_elements"))


def report(blocks: DataFrame, pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """A document's diagnostics with ``layout``: for each page its number and a map of element types to their counts.
    ``pages`` has doc_id, page_number, width, height and, where a parser gives them, rotation and encrypted."""
    known = pages if {"rotation", "encrypted"} <= set(pages.columns) else None
    by_type = F.map_from_entries(F.array_sort(F.collect_list(F.struct("element_type", "n_elements"))))
    page = counts(elements(blocks, pages)).groupBy("doc_id", "page_number").agg(by_type.alias("elements"))
    layout = page.groupBy("doc_id").agg(F.collect_list(F.struct("page_number", "elements")).alias("l")).select("doc_id", F.array_sort("l", lambda a, b: a["page_number"] - b["page_number"]).alias("layout"))
    return diagnose(blocks, images, known).join(layout, "doc_id", "left")
