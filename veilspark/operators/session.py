"""Manual marks, remembered terms, summaries of a review."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.geometry import iou
from veilspark.functions.spans import spans_of
from veilspark.operators.decision import REDACT, Policy
from veilspark.operators.registry import with_ids

TERMS = "term string, label string, case_sensitive boolean, added_from string, ignored boolean"


def folded(text: Column) -> Column:
    """The text without regard to case; a sharp s is two."""
    return F.lower(F.regexp_replace(text, "[ßẞ]", "ss"))


def term_key(term: Column, label: Column) -> Column:
    return F.concat_ws("\x1f", folded(term), label)


def tidy_label(label: Column) -> Column:
    """Upper case, blanks as underscores."""
    return F.regexp_replace(F.upper(F.trim(label)), r"\s+", "_")


def add_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Terms with new ones: same key replaces, and is no longer ignored. Blank terms are an error of the caller and left out."""
    new = new.filter(F.trim("term") != "").withColumns({"ignored": F.lit(False), "age": F.lit(1)})
    every = terms.withColumn("age", F.lit(0)).unionByName(new.select(*terms.columns, "age"))
    last = Window.partitionBy(term_key(F.col("term"), F.col("label"))).orderBy(F.desc("age"), "term")
    return every.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth", "age")


def remove_terms(terms: DataFrame, gone: DataFrame) -> DataFrame:
    k = gone.select(term_key(F.col("term"), F.col("label")).alias("gone_")).distinct()
    return terms.join(k, term_key(F.col("term"), F.col("label")) == F.col("gone_"), "left_anti")


def ignore_terms(terms: DataFrame, which: DataFrame) -> DataFrame:
    k = which.select(term_key(F.col("term"), F.col("label")).alias("k_")).distinct()
    return terms.join(k, term_key(F.col("term"), F.col("label")) == F.col("k_"), "left").withColumn("ignored", F.col("ignored") | F.col("k_").isNotNull()).drop("k_")


def active_terms(terms: DataFrame) -> DataFrame:
    return terms.filter("not ignored")


def loose_pattern(term: str, case_sensitive: bool = False) -> str:
    """The term with any white space between its words."""
    body = r"\s+".join(re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", w) for w in term.split())
    return body if case_sensitive else f"(?iu:{body})"


def _bare(term: str = "term") -> Column:
    """The term without white space of any kind at its ends."""
    return F.regexp_replace(term, r"^\s+|\s+$", "")


def _pattern_column() -> Column:
    quoted = F.regexp_replace(_bare(), r"\\E", r"\\E\\\\E\\Q")
    body = F.concat(F.lit(r"\Q"), F.regexp_replace(quoted, r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))
    return F.when(F.col("case_sensitive"), body).otherwise(F.concat(F.lit("(?iu:"), body, F.lit(")")))


FEW_TERMS = 200  # so many are searched for in one pass; longer lists meet the blocks by a join


def instances(blocks: DataFrame, terms: DataFrame, detector: str = "manual") -> DataFrame:
    """Every occurrence of every term in the text blocks, as detections with detection_id over page-level offsets (each
    block begins one character after the one before ends).

    A short list becomes literal patterns of one pass over the blocks. A longer one meets the blocks on the first
    characters of its terms, so texts are searched only for terms that can occur in them."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
    text = blocks.filter(F.col("block_type") == "text").withColumn("page_start", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).cast("int"))
    few = terms.select("term", "label", "case_sensitive").limit(FEW_TERMS + 1).collect()
    if not few:
        found = text.withColumns({"term": F.lit(""), "label": F.lit(""), "s": F.struct(F.lit("").alias("value"), F.lit(0).alias("start"), F.lit(0).alias("end"))}).filter(F.lit(False))
    elif len(few) <= FEW_TERMS:

        def one(term: str, label: str, exact: bool) -> Column:
            return F.transform(spans_of(F.col("text"), loose_pattern(term, exact)), lambda s: F.struct(F.lit(term).alias("term"), F.lit(label).alias("label"), s.alias("s")))

        found = text.withColumn("hit", F.explode(F.concat(*(one(*r) for r in few)))).select(*text.columns, "hit.*")
    else:
        words = text.select("doc_id", "page_number", "block_ord", F.explode(F.array_distinct(_grams(F.lower("text")))).alias("gram"))
        t = terms.withColumns({"term_pattern": _pattern_column(), "gram": F.substring(F.split(F.lower(_bare()), r"\s+")[0], 1, 3)})
        hits = words.join(t, "gram").select("doc_id", "page_number", "block_ord", "term", "label", "term_pattern").distinct()
        found = text.join(hits, ["doc_id", "page_number", "block_ord"]).withColumn("s", F.explode(spans_of(F.col("text"), F.col("term_pattern"))))
    out = found.select("doc_id", "page_number", "block_ord", F.lit(detector).alias("detector_name"), tidy_label(F.col("label")).alias("detection_type"), F.col("s.value").alias("text"), (F.col("page_start") + F.col("s.start")).alias("start"), (F.col("page_start") + F.col("s.end")).alias("end"), "bbox", F.lit(1.0).alias("confidence"), F.array(F.concat(F.lit("marked term '"), F.col("term"), F.lit("'"))).alias("reasons"))
    return with_ids(out)


def _grams(text: Column) -> Column:
    """The first three characters at every place (fewer at the end): what a term's first word can begin with."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.flatten(F.transform(at, lambda i: F.array(F.substring(text, i, F.lit(3)), F.substring(text, i, F.lit(2)), F.substring(text, i, F.lit(1)))))


def mark(entries: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to add, counts of added and skipped per document). An instance is skipped if its id is known, or a known or
    earlier instance of the same text on the page overlaps its box by more than half (IoU)."""
    known = entries.select("doc_id", "page_number", folded(F.col("text")).alias("k"), F.struct("bbox", F.lit(True).alias("old")).alias("e"))
    ids = entries.select("doc_id", "detection_id").distinct()
    fresh = found.join(ids, ["doc_id", "detection_id"], "left_anti").dropDuplicates(["doc_id", "detection_id"])
    old = known.groupBy("doc_id", "page_number", "k").agg(F.collect_list(F.col("e.bbox")).alias("old_boxes"))
    columns = found.columns
    grouped = fresh.groupBy("doc_id", "page_number", folded(F.col("text")).alias("k")).agg(F.array_sort(F.collect_list(F.struct("start", F.struct(*columns).alias("row")))).alias("all")).join(old, ["doc_id", "page_number", "k"], "left")
    boxes = F.coalesce("old_boxes", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    zero = F.struct(boxes.alias("boxes"), F.slice("all", 1, 0).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        twin = F.exists(acc["boxes"], lambda b: iou(b, x["row"]["bbox"]) > 0.5)
        return F.struct(F.when(twin, acc["boxes"]).otherwise(F.concat(acc["boxes"], F.array(x["row"]["bbox"]))).alias("boxes"), F.when(twin, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"))

    kept = grouped.select(F.explode(F.aggregate(F.col("all"), zero, step, lambda a: a["kept"])).alias("x")).select("x.row.*")
    added = kept.withColumns({"suggested_action": F.lit(REDACT), "suggestion_reason": F.lit("marked by the reviewer"), "decision": F.lit(REDACT)})
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(added.groupBy("doc_id").agg(F.count(F.lit(1)).alias("added")), "doc_id", "left")
    return added, n.select("doc_id", F.coalesce("added", F.lit(0)).cast("bigint").alias("added"), (F.col("n") - F.coalesce("added", F.lit(0))).cast("bigint").alias("skipped"))


def remembered(blocks: DataFrame, terms: DataFrame, policy: Policy) -> DataFrame:
    """Entries for active terms: the policy's action for the label is the suggestion, no decision yet."""
    found = instances(blocks, active_terms(terms), "remembered")
    action = F.lit(policy.default_action)
    for kind, p in policy.types.items():
        action = F.when(F.col("detection_type") == kind, F.lit(p.get("action", REDACT))).otherwise(action)
    return found.withColumns({"suggested_action": action, "suggestion_reason": F.lit("suggested from workspace memory"), "decision": F.lit(None).cast("string")})


def forget(entries: DataFrame, terms: DataFrame, text: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Entries and terms without a remembered term."""
    gone = (F.col("detector_name") == "remembered") & (folded(F.col("text")) == folded(F.lit(text))) & (F.col("detection_type") == label)
    return entries.filter(~gone), terms.filter(~((folded(F.col("term")) == folded(F.lit(text))) & (tidy_label(F.col("label")) == label)))


def remove_manual(entries: DataFrame, detection_id: str) -> DataFrame:
    return entries.filter(~((F.col("detector_name") == "manual") & (F.col("detection_id") == detection_id)))


def summary(entries: DataFrame) -> DataFrame:
    """What a reviewer's list shows: one JSON text per entry."""
    return entries.select("doc_id", "detection_id", F.to_json(F.struct("detection_id", "detection_type", "text", "page_number", "confidence", "suggested_action", F.coalesce("decision", "suggested_action").alias("action"))).alias("entry"))


def by_type(entries: DataFrame) -> DataFrame:
    """Groups of a document's entries by type and effective action."""
    return entries.groupBy("doc_id", "detection_type", F.coalesce("decision", "suggested_action").alias("action")).agg(F.count(F.lit(1)).alias("n_entries"))


def select_chars(words: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Words that a dragged rectangle meets, with sel_from and sel_to: the characters its left and right edge cut off,
    rounded in proportion to the word's width. Words with nothing selected are left out."""
    b, n = F.col("bbox"), F.length("text")
    hit = (b["x0"] < x1) & (b["x1"] > x0) & (b["y0"] < y1) & (b["y1"] > y0) & (n > 0) & (b["x1"] > b["x0"])
    at = lambda x: F.floor((x - b["x0"]) / (b["x1"] - b["x0"]) * n + 0.5).cast("int")
    out = words.filter(hit).withColumns({"sel_from": F.greatest(F.lit(0), at(x0)), "sel_to": F.least(n, at(x1))})
    return out.filter("sel_to > sel_from")
