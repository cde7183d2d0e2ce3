"""The words of pages, with the edges of their characters where a parser knows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.geometry import words_with_boxes
from veilspark.schema import BBOX

NEAR = 2.0  # points that a word's corner may lie off the same word's in the parser's text layer
WORD = f"struct<text:string,bbox:{BBOX},edges:array<double>>"


def glyph_words(chars: DataFrame) -> DataFrame:
    """doc_id, page_number, word, x0, y0, edges from characters (doc_id, page_number, run, char_ord, char, bbox): the runs of a
    page cut at white space. ``edges`` are the left edges of a word's characters and its rightmost edge."""
    key = ["doc_id", "page_number", "run"]
    rows = chars.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("char_ord", "char", "bbox"))).alias("cs"))
    zero = F.struct(F.slice("cs", 1, 0).alias("now"), F.slice(F.array("cs"), 1, 0).alias("out"))
    ended = lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"])

    def step(a: Column, c: Column) -> Column:
        blank = F.coalesce(c["char"], F.lit("")).rlike(r"^(?U)\s*$")
        return F.struct(F.when(blank, F.slice(a["now"], 1, 0)).otherwise(F.concat(a["now"], F.array(c))).alias("now"), F.when(blank, ended(a)).otherwise(a["out"]).alias("out"))

    words = rows.select(*key, F.posexplode(F.aggregate("cs", zero, step, ended)).alias("nth", "w"))
    of = lambda f: F.transform("w", f)
    return words.select("doc_id", "page_number", F.array_join(of(lambda c: c["char"]), "").alias("word"), F.array_min(of(lambda c: c["bbox"]["x0"])).alias("x0"), F.array_min(of(lambda c: c["bbox"]["y0"])).alias("y0"), F.concat(of(lambda c: c["bbox"]["x0"]), F.array(F.array_max(of(lambda c: c["bbox"]["x1"])))).alias("edges"))


def with_edges(blocks: DataFrame, glyphs: DataFrame) -> DataFrame:
    """The blocks, their words with ``edges``: those of the word of the same text whose corner lies within NEAR points in x and
    in y, the nearest of several; null where there is none, or where it doesn't have an edge for each character."""
    at = ["doc_id", "page_number", "block_ord"]
    w = blocks.select(*at, F.posexplode("words").alias("nth", "w"))
    g = glyphs.select(F.col("doc_id").alias("gd"), F.col("page_number").alias("gp"), F.col("word").alias("gw"), F.col("x0").alias("gx"), F.col("y0").alias("gy"), "edges")
    dx, dy = F.abs(F.col("gx") - F.col("w.bbox.x0")), F.abs(F.col("gy") - F.col("w.bbox.y0"))
    same = (F.col("gd") == F.col("doc_id")) & (F.col("gp") == F.col("page_number")) & (F.col("gw") == F.col("w.text")) & (dx <= NEAR) & (dy <= NEAR) & (F.size("edges") == F.length("gw") + 1)
    hits = w.join(g, same).groupBy(*at, "nth").agg(F.min_by("edges", F.struct(dx + dy, F.col("gx"), F.col("gy"))).alias("edges"))
    full = w.join(hits, [*at, "nth"], "left").groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.struct("w.text", "w.bbox", "edges").cast(WORD).alias("w")))), lambda x: x["w"]).alias("words_"))
    return blocks.join(full, at, "left").withColumn("words", F.coalesce("words_", F.array().cast(f"array<{WORD}>"))).drop("words_")


def _twins_out(words: Column) -> Column:
    from veilspark.functions.geometry import iou

    twin = lambda a, w: F.exists(a, lambda k: (k["text"] == w["text"]) & (iou(k["bbox"], w["bbox"]) > 0.5))
    return F.aggregate(words, F.slice(words, 1, 0), lambda a, w: F.when(twin(a, w), a).otherwise(F.concat(a, F.array(w))))


def page_words(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, word_ord, text, bbox (and edges, where the words have them): what a page's text layer shows. Blocks'
    words in order; blocks without ``words`` are cut in proportion; of twins on a page the first stays."""
    if "words" not in blocks.columns:
        blocks = blocks.withColumn("words", words_with_boxes(F.col("text"), F.col("bbox")))
    text = blocks.filter(F.col("block_type") == "text")
    page = text.groupBy("doc_id", "page_number").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "words"))), lambda x: x["words"])).alias("words"))
    return page.select("doc_id", "page_number", F.posexplode(_twins_out(F.col("words"))).alias("word_ord", "w")).select("doc_id", "page_number", "word_ord", "w.*")


def one_page(blocks: DataFrame, pages: DataFrame, doc_id: int, page_number: int) -> DataFrame:
    """The words of one page; an error where the document has no such page."""
    here = lambda df: df.filter((F.col("doc_id") == doc_id) & (F.col("page_number") == page_number))
    if here(pages).isEmpty():
        raise ValueError(f"document {doc_id} has no page {page_number}")
    return page_words(here(blocks))
