"""Context scoring: labels near a number raise or lower its confidence.

Every detection of a type with terms is looked up in its page's text blocks, its line and the neighbouring blocks are
searched, and the closest evidence wins; evidence for it goes before evidence against it at the same distance. All steps are
joins on (document, page), windows over blocks and one chain of conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.geometry import touch
from veilspark.functions.lexicon import CONTEXT_TERMS
from veilspark.functions.spans import after, before, cut_out, digits, first_term, line_around

# Changes of confidence, and the floor under which a lowered detection goes.
LINE_FOR, NEAR_FOR, LINE_AGAINST, NEAR_AGAINST, FLOOR = 0.10, 0.05, 0.35, 0.20, 0.3
HARD = ("PHONE",)  # bare numbers of these types go when their line speaks against them


def _by_type(text: Column, which: int) -> Column:
    out = F.lit(None).cast("string")
    for kind, terms in CONTEXT_TERMS.items():
        out = F.when(F.col("detection_type") == kind, first_term(text, terms[which])).otherwise(out)
    return out


KEY = ["doc_id", "page_number", "block_ord", "detector_name", "pattern_ord", "start", "end", "text"]


def located(detections: DataFrame, blocks: DataFrame) -> DataFrame:
    """The detections, those of types with terms with at_text, the text of the block where their span reads the same (or has
    the same digits), and prev_text and next_text, its neighbours'; of several such blocks the first whose box they touch,
    else the first. One join, so that what detects runs once."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("block_ord")
    around = blocks.filter(F.col("block_type") == "text").select(F.col("doc_id").alias("at_doc"), F.col("page_number").alias("at_page"), F.col("block_ord").alias("at_block"), F.col("text").alias("at_text"), F.col("bbox").alias("at_box"), F.lag("text").over(order).alias("prev_text"), F.lead("text").over(order).alias("next_text"))
    here = cut_out(F.col("at_text"), F.col("start"), F.col("end"))
    same = (F.col("end") <= F.length("at_text")) & ((here == F.col("text")) | ((digits(F.col("text")) != "") & (digits(here) == digits(F.col("text")))))
    on = (F.col("doc_id") == F.col("at_doc")) & (F.col("page_number") == F.col("at_page")) & F.col("detection_type").isin(list(CONTEXT_TERMS)) & same
    # rank, not row_number: equal detections all stay
    best = Window.partitionBy(*KEY).orderBy(F.when(touch(F.col("at_box"), F.col("bbox")), 0).otherwise(1), "at_block")
    return detections.join(around, on, "left").withColumn("nth", F.rank().over(best)).filter("nth = 1").drop("nth", "at_doc", "at_page", "at_block", "at_box")


def score(detections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Detections with changed confidence and one more reason, and ``dropped``. Types without terms, and detections whose
    block isn't found, pass unchanged."""
    columns = detections.columns
    mine = located(detections, blocks)
    line = line_around(F.col("at_text"), F.col("start"), F.col("end"))
    rest = F.concat(before(F.col("at_text"), F.col("start")), after(F.col("at_text"), F.col("end")))
    near = F.concat_ws("\n", rest, F.col("prev_text"), F.col("next_text"))
    mine = mine.withColumns({"lp": _by_type(line, 0), "ln": _by_type(line, 1), "np": _by_type(near, 0), "nn": _by_type(near, 1)})
    bare = F.col("detection_type").isin(*HARD) & ~F.ltrim("text").rlike("^[+0]")
    conf = F.col("confidence")
    delta = (
        F.when(F.col("lp").isNotNull(), F.lit(LINE_FOR))
        .when(F.col("ln").isNotNull() & bare, -conf)
        .when(F.col("ln").isNotNull(), F.lit(-LINE_AGAINST))
        .when(F.col("np").isNotNull(), F.lit(NEAR_FOR))
        .when(F.col("nn").isNotNull(), F.lit(-NEAR_AGAINST))
    )
    q = lambda a, c, b: F.concat(F.lit(a), F.col(c), F.lit(b))
    reason = (
        F.when(F.col("lp").isNotNull(), q("near label '", "lp", "'"))
        .when(F.col("ln").isNotNull() & bare, q("bare number in reference context ('", "ln", "') — dropped"))
        .when(F.col("ln").isNotNull(), q("reference context on the same line ('", "ln", "')"))
        .when(F.col("np").isNotNull(), q("label '", "np", "' in surrounding text"))
        .when(F.col("nn").isNotNull(), q("reference context in surrounding text ('", "nn", "')"))
    )
    new = F.when(delta.isNull(), conf).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf + delta)))
    scored = mine.withColumns({"new": new, "why": reason})
    dropped = (F.col("new") < conf) & (F.col("new") < FLOOR)
    reasons = F.when(F.col("why").isNull(), F.col("reasons")).otherwise(F.array_append("reasons", F.col("why")))
    return scored.select(*(F.col("new").alias(c) if c == "confidence" else reasons.alias(c) if c == "reasons" else F.col(c) for c in columns), dropped.alias("dropped"))


def apply(detections: DataFrame, blocks: DataFrame) -> DataFrame:
    return score(detections, blocks).filter("not dropped").drop("dropped")
