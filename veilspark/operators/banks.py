"""Statement profiles: which bank a document comes from, account, code, holder and period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import lexicon as lx


def full_text(blocks: DataFrame) -> DataFrame:
    """doc_id, page_count, text: the block texts that aren't empty, joined by newlines."""
    rows = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_number", "block_ord", "text"))))
    return blocks.groupBy("doc_id").agg(F.countDistinct("page_number").alias("page_count"), F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def _first(text: Column, patterns: tuple[str, ...], group: int = 0) -> Column:
    """The first match of the first pattern that matches at all."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns))


def parsed_date(x: Column) -> Column:
    x = F.regexp_replace(x, r"\s+", " ")
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in ("d MMM yyyy", "d MMMM yyyy", "d/M/yyyy", "d-M-yyyy"))).cast("date")


def period(text: Column) -> tuple[Column, Column]:
    """Start and end from the first pattern that matches."""
    which = F.coalesce(*(F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(lx.PERIODS)))
    side = lambda g: F.coalesce(*(F.when(which == i, F.regexp_extract(text, p, g)) for i, p in enumerate(lx.PERIODS)))
    return parsed_date(side(1)), parsed_date(side(2))


def profiles(docs: DataFrame) -> DataFrame:
    """One row per document and bank (generic last): confidence and fields. A code of another bank gives confidence 0 and
    no fields. ``docs``: doc_id, page_count, text."""
    text = F.col("text")
    code = _first(text, (lx.BANK_IFSC,))
    start, end = period(text)
    base = docs.select("doc_id", "page_count", "text", code.alias("ifsc_code"), _first(text, lx.HOLDERS, 1).alias("account_holder"), start.alias("statement_start"), end.alias("statement_end"), F.lower(text).alias("low"))
    out = []
    for k, (bank, (aliases, prefixes, accounts)) in enumerate(lx.BANKS.items()):
        foreign = F.col("ifsc_code").isNotNull() & ~F.substring("ifsc_code", 1, 4).isin(*prefixes)
        named = reduce(Column.__or__, (F.col("low").contains(a) for a in aliases))
        score = F.when(foreign, 0.0).otherwise(F.when(F.col("ifsc_code").isNotNull(), 0.5).otherwise(0.0) + F.when(named, 0.3).otherwise(0.0))
        own = lambda c: F.when(~foreign, c)  # noqa: E731, B023
        out.append(base.select("doc_id", "page_count", F.lit(bank).alias("bank_name"), F.lit(k).alias("bank_ord"), score.alias("confidence"), own(_first(text, accounts)).alias("account_number"), own(F.col("ifsc_code")).alias("ifsc_code"), own(F.col("account_holder")).alias("account_holder"), own(F.col("statement_start")).alias("statement_start"), own(F.col("statement_end")).alias("statement_end")))
    one = lambda c: F.when(F.col(c).isNotNull(), 0.1).otherwise(0.0)
    generic = F.lit(0.1) + one("ifsc_code") + one("statement_start") + one("account_holder")
    out.append(base.select("doc_id", "page_count", F.lit("generic").alias("bank_name"), F.lit(len(lx.BANKS)).alias("bank_ord"), generic.alias("confidence"), F.lit(None).cast("string").alias("account_number"), "ifsc_code", "account_holder", "statement_start", "statement_end"))
    return reduce(DataFrame.unionByName, out)


def best(found: DataFrame) -> DataFrame:
    """The profile of highest confidence of each document; the bank registered first wins ties."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "bank_ord")
    return found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
