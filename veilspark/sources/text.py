"""Text as blocks: lines of documents, wrapped and paginated as on A4 pages of a fixed-width font."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.geometry import box

# The page that plain text is laid out on (points), its characters a line and lines a page.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN, FONT, LINE = 595.0, 842.0, 50.0, 10.0, 14.0
CHARS_PER_LINE, LINES_PER_PAGE = 82, 53
CHAR_WIDTH = 6.0


def line_blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A block per line that isn't empty, as it stands; page and box follow from the line's number."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "text"))
    return _placed(rows).filter(F.col("text") != "")


def _placed(rows: DataFrame) -> DataFrame:
    on_page = F.col("line_no") % LINES_PER_PAGE
    y0 = F.lit(MARGIN) + on_page * F.lit(LINE)
    wide = F.greatest(F.length("text"), F.lit(1)) * F.lit(CHAR_WIDTH)
    return rows.select("doc_id", (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("int").alias("page_number"), F.col("line_no").cast("int").alias("block_ord"), F.lit("text").alias("block_type"), "text", box(F.lit(MARGIN), y0, F.lit(MARGIN) + wide, y0 + F.lit(LINE)).alias("bbox"))


def wrap_line(line: str, width: int = CHARS_PER_LINE) -> list[str]:
    """Parts of at most ``width`` characters, cut at the last blank that allows it; blanks after a cut go."""
    out = []
    while len(line) > width:
        at = line.rfind(" ", 1, width + 1)
        at = at if at > 0 else width
        out.append(line[:at])
        line = line[at:].lstrip(" ")
    return [*out, line]


def _wrapped(lines: pd.Series) -> pd.Series:
    return lines.map(lambda xs: [part for x in xs for part in wrap_line(x)])


def wrapped_blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Blocks of wrapped lines, tabs as four blanks. Only documents with a line over the width go through Python."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\t", "    "), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    rows = docs.select(F.col(doc_id).alias("doc_id"), lines.alias("lines"))
    long = F.exists("lines", lambda x: F.length(x) > CHARS_PER_LINE)
    both = rows.filter(~long).unionByName(rows.filter(long).withColumn("lines", F.pandas_udf(_wrapped, T.ArrayType(T.StringType()))("lines")))
    return _placed(both.select("doc_id", F.posexplode("lines").alias("line_no", "text"))).filter(F.col("text") != "")


def pages_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "page_number").distinct().withColumns({"width": F.lit(PAGE_WIDTH), "height": F.lit(PAGE_HEIGHT)})


def blocks_from_words(raw: DataFrame, words: DataFrame) -> DataFrame:
    """Text blocks from boxes (doc_id, page_number, block_ord, bbox) and words (doc_id, page_number, text, bbox): the words
    whose boxes overlap a block's, by y0 and x0, joined by blanks. A word that overlaps two blocks is in both."""
    w = words.select("doc_id", "page_number", F.col("text").alias("w"), F.col("bbox").alias("wb"))
    both = raw.join(w, ["doc_id", "page_number"]).filter((F.col("wb.x0") < F.col("bbox.x1")) & (F.col("bbox.x0") < F.col("wb.x1")) & (F.col("wb.y0") < F.col("bbox.y1")) & (F.col("bbox.y0") < F.col("wb.y1")))
    row = F.struct(F.col("wb.y0").alias("y"), F.col("wb.x0").alias("x"), F.col("w").alias("text"), F.col("wb").alias("bbox"))
    out = both.groupBy("doc_id", "page_number", "block_ord", "bbox").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(r["text"].alias("text"), r["bbox"].alias("bbox"))).alias("words"))
    return out.select("doc_id", "page_number", "block_ord", F.lit("text").alias("block_type"), F.array_join(F.transform("words", lambda r: r["text"]), " ").alias("text"), "bbox", "words")


def preview(text: Column, size: int = 60) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
