"""Text quality, and the choice between native text, OCR and both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the parts, and the limits under which a part is named as a reason.
WEIGHTS = {"printable_ratio": 0.30, "replace_penalty": 0.20, "fragmentation_score": 0.15, "token_quality": 0.20, "whitespace_ratio": 0.15}
SCANNED_IMAGES, LOW, MEDIUM, SCANNED_QUALITY = 3, 0.3, 0.7, 0.2


def _parts(text: Column) -> dict[str, Column]:
    n = F.length(text).cast("double")
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    part = lambda size: F.size(F.filter(words, size)) / F.size(words)
    zero = F.lit(0.0)
    blanks = share(r"\s")
    return {
        "printable_ratio": F.length(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f�]", "")) / n,
        "replace_penalty": F.greatest(zero, 1 - share("�") * 5.0),
        "fragmentation_score": F.greatest(zero, 1 - part(lambda w: F.length(w) < 3) * 2),
        "token_quality": F.greatest(zero, 1 - part(lambda w: F.length(w) > 50) * 10.0),
        "whitespace_ratio": F.when((blanks < 0.02) | (blanks > 0.50), 0.0).otherwise(1.0),
    }


def _rounded(value: Column) -> Column:
    """A number from 0 to 1 to 4 places, half up, after 18 decimal places. F.round goes by the shortest decimal that reads
    back as the number, which puts 0.3 + 0.2 + 0.11625 + 0.2 + 0.15 under 0.96625; SQL's decimals do not."""
    steps = F.rint(value * 1e18).cast("bigint")
    return F.call_function("div", steps + 50_000_000_000_000, F.lit(100_000_000_000_000)).cast("double") / 10000.0


def quality(df: DataFrame, column: str = "text") -> DataFrame:
    """The rows with overall_score, its five parts (each 0 to 1, to 4 places) and quality_reasons. Blank text scores 0."""
    text = F.coalesce(F.col(column), F.lit(""))
    blank = ~text.rlike(r"\S")
    parts = _parts(F.when(blank, F.lit(None)).otherwise(text))
    out = df.withColumns({f"q_{k}": F.coalesce(v, F.lit(0.0)) for k, v in parts.items()})
    total = sum((F.col(f"q_{k}") * w for k, w in list(WEIGHTS.items())[1:]), F.col("q_printable_ratio") * WEIGHTS["printable_ratio"])
    share = (F.length(text) - F.length(F.regexp_replace(text, r"\s", ""))) / F.greatest(F.length(text), F.lit(1))
    notes = [
        (F.col("q_fragmentation_score") < 0.6, "fragmented text (many short words)"),
        (F.col("q_replace_penalty") < 0.7, "high replacement character count"),
        (F.col("q_printable_ratio") < 0.7, "low printable character ratio"),
        (share > 0.50, "mostly whitespace"),
        (F.col("q_token_quality") < 0.6, "very long unbroken tokens detected"),
        (share < 0.02, "very little whitespace (dense text)"),
    ]
    reasons = F.when(blank, F.array(F.lit("empty or blank text"))).otherwise(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in notes))))
    final = {"overall_score": F.when(blank, 0.0).otherwise(_rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))), "quality_reasons": reasons} | {k: _rounded(F.col(f"q_{k}")) for k in WEIGHTS}
    return out.withColumns(final).drop(*(f"q_{k}" for k in WEIGHTS))


def looks_scanned(pages: Column, images: Column, score: Column) -> Column:
    per = images / F.greatest(pages, F.lit(1))
    return F.when(pages == 0, F.lit(False)).otherwise((per > SCANNED_IMAGES) | ((per > 0) & (score < SCANNED_QUALITY)))


def recommend(encrypted: Column, pages: Column, has_text: Column, scanned: Column, score: Column) -> Column:
    """native, hybrid or ocr."""
    return F.when(encrypted | (pages == 0) | scanned | ~has_text | (score < LOW), "ocr").when(score < MEDIUM, "hybrid").otherwise("native")


def route(recommendation: Column, auto: bool, force_ocr: bool, has_native_text: Column) -> Column:
    """Which text is used: native where nothing asks for OCR or the recommendation is native; else both, or OCR alone
    where there is no native text."""
    if not auto and not force_ocr:
        return F.lit("native")
    after = F.when(has_native_text, "hybrid").otherwise("ocr")
    return F.when(recommendation == "native", "native").otherwise(after) if auto else after


def label(source: Column) -> Column:
    """A sentence for each source of text."""
    return F.when(source == "native", "Native text extraction").when(source == "ocr", "Full OCR processing").when(source == "hybrid", "Hybrid (native + OCR merge)").otherwise(F.concat(F.lit("Unknown ("), source, F.lit(")")))


def diagnose(blocks: DataFrame, images: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """One row per document: page_count, image_count, score of the joined page texts, scanned, recommendation, is_encrypted
    and rotated_pages. ``pages`` (doc_id, page_number, rotation, encrypted, as parsers give them) adds documents and pages
    without blocks; a page is rotated if its angle isn't 0 or 360. Without it nothing is rotated or encrypted."""
    text = F.filter(F.transform(F.array_sort(F.collect_list(F.when(F.col("block_type") == "text", F.struct("page_number", "block_ord", "text")))), lambda x: x["text"]), lambda x: x.rlike(r"\S"))
    docs = blocks.groupBy("doc_id").agg(F.countDistinct("page_number").alias("page_count"), F.sum((F.col("block_type") == "image").cast("bigint")).alias("image_count"), F.array_join(text, "\n").alias("text"))
    if images is not None:
        docs = docs.drop("image_count").join(images.select("doc_id", "image_count"), "doc_id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))
    none = F.lit(False), F.array().cast("array<int>")
    if pages is None:
        docs = docs.withColumns({"is_encrypted": none[0], "rotated_pages": none[1]})
    else:
        turned = F.when(~F.coalesce("rotation", F.lit(0)).isin(0, 360), F.col("page_number").cast("int"))
        of = pages.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages_"), F.coalesce(F.max("encrypted"), none[0]).alias("is_encrypted"), F.array_sort(F.collect_set(turned)).alias("rotated_pages"))
        docs = docs.join(of, "doc_id", "full").withColumns({"page_count": F.greatest(F.coalesce("pages_", F.lit(0)), F.coalesce("page_count", F.lit(0))), "image_count": F.coalesce("image_count", F.lit(0)), "text": F.coalesce("text", F.lit("")), "is_encrypted": F.coalesce("is_encrypted", none[0]), "rotated_pages": F.coalesce("rotated_pages", none[1])}).drop("pages_")
    scored = quality(docs)
    scanned = looks_scanned(F.col("page_count"), F.col("image_count"), F.col("overall_score"))
    has = F.col("text") != ""
    return scored.select("doc_id", "page_count", "image_count", has.alias("has_native_text"), "overall_score", scanned.alias("estimated_scanned"), recommend(F.col("is_encrypted"), F.col("page_count"), has, scanned, F.col("overall_score")).alias("recommendation"), "is_encrypted", "rotated_pages")
