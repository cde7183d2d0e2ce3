"""Detectors: blocks in, detections out.

A detector lists patterns; their matches are found in one pass over each block, checked by expressions, and exploded
once. Document-wide de-duplication is a window (exact) or an ordered fold (containment). Detections keep the block they
came from, so later stages need not look for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import lexicon as lx
from veilspark.functions.checksum import verhoeff_ok
from veilspark.functions.geometry import range_box
from veilspark.functions.spans import after, before, cut_out, digits, in_slashes, spans_of
from veilspark.schema import DETECTION_COLUMNS

Rule = Callable[[Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class Detector:
    """A pattern detector. The rules get (raw match, block text, start, end) as columns.

    ``spans``: optional replacement of the plain matches of a pattern; ``mask``: cheap test of the block's text;
    ``dedupe``: "none", "exact" (first of each text in a document) or "containment" (no digits within digits)."""

    name: str
    type: str
    patterns: tuple[str, ...]
    accept: Rule
    confidence: Rule
    reasons: Rule
    value: Rule = lambda raw, text, start, end: raw
    length: Rule | None = None
    mask: Callable[[Column], Column] | None = None
    dedupe: str = "none"
    extra: dict = field(default_factory=dict)


def _constant(x: float) -> Rule:
    return lambda *_: F.lit(x)


def _notes(*notes: str) -> Rule:
    return lambda *_: F.array(*(F.lit(n) for n in notes))


def _tld(email: Column) -> Column:
    return F.substring_index(email, ".", -1)


def unglued(email: Column) -> Column:
    """An address without a capitalised word that extraction has glued to its top-level domain."""
    tld = _tld(email)
    longest = "|".join(sorted(lx.TLDS, key=len, reverse=True))
    known = F.regexp_extract(tld, rf"^((?i:{longest}))(?=\p{{Lu}})", 1)
    cut = F.substring(email, F.lit(1), F.length(email) - (F.length(tld) - F.length(known)))
    return F.when(F.lower(tld).isin(lx.TLDS) | (known == ""), email).otherwise(cut)


def email_ok(email: Column) -> Column:
    local, domain = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    return (F.length(email) <= 254) & F.length(local).between(1, 64) & (domain != "") & ~domain.contains("..") & F.lower(_tld(email)).isin(lx.TLDS) & domain.rlike(r"^[\p{L}\p{N}.-]+$")


def phone_ok(raw: Column) -> Column:
    d = digits(raw)
    return F.length(d).between(10, 15) & ((F.length(d) != 10) | d.rlike("^[6-9]"))


def account_ok(number: Column) -> Column:
    n = F.length(number)
    zeros = n - F.length(F.regexp_replace(number, "0", ""))
    return n.between(9, 18) & ~number.rlike(r"^(.)\1*$") & ~((n == 10) & number.rlike("^[6-9]")) & (n != 12) & ~((n >= 10) & (zeros > n * F.lit(0.7)))


def _free_number(text: Column, start: Column, end: Column) -> Column:
    """Neither a ledger line's marker nor part of a slashed reference."""
    return ~after(text, end).rlike(lx.LEDGER) & ~in_slashes(text, start, end)


def _upi_handle(raw: Column) -> Column:
    return F.substring_index(raw, "@", -1)


def _phone_confidence(raw: Column, *_: Column) -> Column:
    return F.when(F.length(digits(raw)) == 10, 0.85).when(raw.rlike(r"^[+0]"), 0.9).otherwise(0.7)


def _phone_reasons(raw: Column, *_: Column) -> Column:
    fmt = F.lit("matches phone format")
    return (
        F.when(F.length(digits(raw)) == 10, F.array(F.lit("10-digit mobile number starting with 6-9")))
        .when(raw.startswith("+"), F.array(fmt, F.lit("has international dialling prefix")))
        .when(raw.startswith("0"), F.array(fmt, F.lit("has trunk prefix '0'")))
        .otherwise(F.array(fmt))
    )


PAN = Detector(
    "pan", "PAN", (lx.PAN,),
    accept=lambda raw, *_: F.substring(raw, 4, 1).isin(*lx.PAN_HOLDERS),
    confidence=_constant(0.95),
    reasons=lambda raw, *_: F.array(F.lit("matches PAN format"), F.concat(F.lit("holder-type code '"), F.substring(raw, 4, 1), F.lit("' is valid"))),
    mask=lambda t: t.rlike("[0-9]{4}[A-Z]"),
)
AADHAAR = Detector(
    "aadhaar", "AADHAAR", (lx.AADHAAR_GROUPS, lx.AADHAAR_PLAIN),
    accept=lambda raw, t, s, e: ~digits(raw).rlike("^[01]") & ~in_slashes(t, s, e) & verhoeff_ok(digits(raw)),
    value=lambda raw, *_: digits(raw),
    confidence=_constant(0.95),
    reasons=_notes("matches 12-digit Aadhaar format", "Verhoeff checksum passed"),
    mask=lambda t: t.rlike("[0-9]{4}"),
    dedupe="exact",
)
EMAIL = Detector(
    "email", "EMAIL", (lx.EMAIL,),
    value=lambda raw, *_: unglued(raw),
    accept=lambda raw, *_: email_ok(unglued(raw)),
    length=lambda raw, *_: F.length(unglued(raw)),
    confidence=_constant(0.9),
    reasons=_notes("matches email address format", "local part and domain are structurally valid"),
    mask=lambda t: t.contains("@"),
)
PHONE = Detector(
    "phone", "PHONE", lx.PHONE,
    accept=lambda raw, t, s, e: phone_ok(raw) & ~in_slashes(t, s, e),
    confidence=_phone_confidence,
    reasons=_phone_reasons,
    mask=lambda t: t.rlike("[0-9]{3}"),
    dedupe="containment",
)
UPI = Detector(
    "upi", "UPI", (lx.UPI,),
    accept=lambda raw, *_: (F.length(raw) <= 50) & ~raw.contains("..") & ~_upi_handle(raw).contains("."),
    confidence=lambda raw, *_: F.when(_upi_handle(raw).isin(lx.UPI_HANDLES), 0.95).otherwise(0.7),
    reasons=lambda raw, *_: F.array(F.lit("matches UPI ID format"), F.concat(F.when(_upi_handle(raw).isin(lx.UPI_HANDLES), F.lit("known payment-provider handle '")).otherwise(F.lit("unrecognised handle '")), _upi_handle(raw), F.lit("'"))),
    mask=lambda t: t.contains("@"),
    dedupe="exact",
)
IFSC = Detector(
    "ifsc", "IFSC", (lx.IFSC,),
    accept=lambda *_: F.lit(True),
    confidence=_constant(0.95),
    reasons=lambda raw, *_: F.concat(F.array(F.lit("matches IFSC format (bank code + '0' + branch code)")), F.when(F.substring(raw, 1, 4).isin(lx.BANK_CODES), F.array(F.concat(F.lit("recognised bank code '"), F.substring(raw, 1, 4), F.lit("'")))).otherwise(F.array().cast("array<string>"))),
    mask=lambda t: t.rlike("[A-Z]{4}0"),
    dedupe="exact",
)
ACCOUNT = Detector(
    "account", "ACCOUNT", (lx.ACCOUNT_LABEL, lx.ACCOUNT_ALONE),
    accept=lambda raw, t, s, e: account_ok(raw) & _free_number(t, s, e),
    confidence=_constant(0.7),
    reasons=_notes("standalone number of common account length (11-15 digits)"),
    mask=lambda t: t.rlike("[0-9]{9}"),
    dedupe="exact",
)


def custom(name: str, detection_type: str, patterns: list[str], accept: Rule | None = None, confidence: float | Rule = 1.0, unicode: bool = False) -> Detector:
    """A detector of the caller's patterns. ``accept`` and ``confidence`` are expressions; a confidence of null rejects. With
    ``unicode``, digits, white space and word edges of all scripts count for \\d, \\s, \\w and \\b, not ASCII's alone."""
    patterns = [f"(?U:{p})" for p in patterns] if unicode else patterns
    score = confidence if callable(confidence) else _constant(confidence)
    ok: Rule = lambda *a: (accept(*a) if accept else F.lit(True)) & score(*a).isNotNull()
    return Detector(name, detection_type, tuple(patterns), accept=ok, confidence=score, reasons=_notes("matches custom pattern"))


def hooked(d: Detector, hook: Callable[[str], float | None]) -> tuple[str, Callable[[DataFrame, int, bool], DataFrame]]:
    """The detector with a Python check for the registry: ``hook`` takes a value and gives its confidence, None rejects it. It
    runs over Arrow batches of what the patterns found, once for each distinct value of a batch, before de-duplication."""

    def check(values: pd.Series) -> pd.Series:
        verdict = {v: hook(v) for v in values.unique()}
        return pd.Series([verdict[v] for v in values], dtype="float64")

    def run(blocks: DataFrame, detector_ord: int, values_only: bool) -> DataFrame:
        rows = scan_all(blocks, [(detector_ord, d)], values_only)
        rows = rows.withColumn("confidence", F.pandas_udf(check, "double")("text")).filter("confidence is not null")
        return first_of_text(rows) if d.dedupe == "exact" else without_contained(rows) if d.dedupe == "containment" else rows

    return d.name, run


def _spans(text: Column, d: Detector, k: int) -> Column:
    plain = spans_of(text, d.patterns[k])
    if d.name == "account" and k == 0:
        # the number that follows the label at once: up to 18 digits of it
        number = lambda s: F.regexp_extract(after(text, s["end"]), r"^[0-9]{9,18}", 0)
        return F.filter(F.transform(plain, lambda s: F.struct(number(s).alias("value"), s["end"].alias("start"), (s["end"] + F.length(number(s))).alias("end"))), lambda s: s["value"] != "")
    return plain


HIT = "array<struct<detector_name:string,detector_ord:int,detection_type:string,text:string,start:int,end:int,confidence:double,reasons:array<string>,pattern_ord:int>>"


def hits(text: Column, d: Detector, detector_ord: int) -> Column:
    """All accepted matches of a detector in a text, as an array of HIT structs, by pattern and place."""

    def by_pattern(k: int) -> Column:
        def one(s: Column) -> Column:
            args = (s["value"], text, s["start"], s["end"])
            end = s["start"] + d.length(*args) if d.length else s["end"]
            fields = {"detector_name": F.lit(d.name), "detector_ord": F.lit(detector_ord), "detection_type": F.lit(d.type), "text": d.value(*args), "start": s["start"], "end": end.cast("int"), "confidence": d.confidence(*args).cast("double"), "reasons": d.reasons(*args), "pattern_ord": F.lit(k)}
            if d is ACCOUNT and k == 0:
                fields |= {"confidence": F.lit(0.85), "reasons": F.array(F.lit("9-18 digit number"), F.lit("follows an account label (e.g. 'A/c No')"))}
            return F.struct(*(c.alias(n) for n, c in fields.items()))

        def ok(s: Column) -> Column:
            out = d.accept(s["value"], text, s["start"], s["end"])
            if d is ACCOUNT and k == 1:
                # after a bank code's "four letters and 0" a number is a branch, not an account
                out = out & ~F.substring(before(text, s["start"]), F.greatest(s["start"] - 14, F.lit(1)), F.lit(15)).rlike("[A-Za-z]{4}0")
            return out

        return F.transform(F.filter(_spans(text, d, k), ok), one)

    found = F.concat(*(by_pattern(k) for k in range(len(d.patterns)))).cast(HIT)
    return F.when(d.mask(text), found).otherwise(F.array().cast(HIT)) if d.mask is not None else found


def scan_all(blocks: DataFrame, chosen: list[tuple[int, Detector]], values_only: bool = False) -> DataFrame:
    """Every accepted match of several detectors (with their ordinals), in one pass over the blocks, not de-duplicated."""
    text = blocks.filter(F.col("block_type") == "text")
    hit = F.explode(F.concat(*(hits(F.col("text"), d, k) for k, d in chosen)))
    words = ["words"] if values_only and "words" in blocks.columns else []
    rows = text.select("doc_id", "page_number", "block_ord", "bbox", *([F.col("text").alias("block_text"), *words] if words else []), hit.alias("h")).select("*", "h.*").drop("h")
    if words:
        rows = rows.withColumn("bbox", range_box(F.col("block_text"), F.col("words"), F.col("bbox"), F.col("start"), F.col("end"))).drop("block_text", "words")
    if any(d is ACCOUNT for _, d in chosen):
        rows = _labelled(rows, text)
    return aligned(rows)


def _labelled(rows: DataFrame, text: DataFrame) -> DataFrame:
    """Standalone account numbers in a block after one that ends with an account label count as labelled. Only a flag for
    each block is sorted by page, and only the few that are set meet the detections."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("block_ord")
    flag = text.select("doc_id", "page_number", "block_ord", F.coalesce(F.col("text").rlike(lx.LABEL_AT_END), F.lit(False)).alias("flag"))
    after_label = flag.withColumn("labelled", F.lag("flag").over(order)).filter("labelled").select("doc_id", "page_number", "block_ord", "labelled")
    on = F.coalesce(F.col("labelled"), F.lit(False)) & (F.col("detector_name") == ACCOUNT.name) & (F.col("pattern_ord") == 1)
    note = F.array_append("reasons", F.lit("previous block ends with an account label"))
    out = rows.join(after_label, ["doc_id", "page_number", "block_ord"], "left")
    return out.withColumns({"confidence": F.when(on, 0.85).otherwise(F.col("confidence")), "reasons": F.when(on, note).otherwise(F.col("reasons"))}).drop("labelled")


def scan(blocks: DataFrame, d: Detector, detector_ord: int = 0, values_only: bool = False, dedupe: str = "document") -> DataFrame:
    """Detections of one detector. ``dedupe="none"`` keeps what a document repeats, for redaction of every place."""
    rows = scan_all(blocks, [(detector_ord, d)], values_only)
    if dedupe == "none" or d.dedupe == "none":
        return rows
    return first_of_text(rows) if d.dedupe == "exact" else without_contained(rows)


def scan_many(blocks: DataFrame, chosen: list[tuple[int, Detector]], values_only: bool = False, dedupe: str = "document") -> DataFrame:
    """Detections of several detectors: one pass for all that de-duplicate by a window or not at all, one more for those
    with an ordered fold."""
    folded = [(k, d) for k, d in chosen if d.dedupe == "containment" and dedupe != "none"]
    plain = [x for x in chosen if x not in folded]
    parts = []
    if plain:
        rows = scan_all(blocks, plain, values_only)
        exact = [d.name for _, d in plain if d.dedupe == "exact"]
        if exact and dedupe != "none":
            # what isn't de-duplicated is alone in its part of the window
            own = F.when(F.col("detector_name").isin(exact), F.lit(None).cast("string")).otherwise(F.concat_ws("|", "page_number", "block_ord", "pattern_ord", "start"))
            part = Window.partitionBy("doc_id", "detector_name", "text", own).orderBy(*ORDER)
            rows = rows.withColumn("nth", F.row_number().over(part)).filter("nth = 1").drop("nth")
        parts.append(rows)
    parts += [without_contained(scan_all(blocks, [x], values_only)) for x in folded]
    return reduce(DataFrame.unionByName, parts)


ORDER = ("page_number", "block_ord", "pattern_ord", "start")


def first_of_text(rows: DataFrame) -> DataFrame:
    """The first detection of each text in a document."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*ORDER))).filter("nth = 1").drop("nth")


def without_contained(rows: DataFrame) -> DataFrame:
    """In document order, a detection whose digits lie within, or hold, those of one already accepted is left out."""
    keyed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, digits(F.col("text")).alias("d"), F.struct(*(c for c in rows.columns if c != "doc_id")).alias("row")))).alias("all"))
    clash = lambda a, x: F.exists(a, lambda k: k["d"].contains(x["d"]) | x["d"].contains(k["d"]))
    fold = F.aggregate(F.col("all"), F.slice(F.col("all"), 1, 0), lambda a, x: F.when(clash(a, x), a).otherwise(F.concat(a, F.array(x))))
    return keyed.select("doc_id", F.explode(F.transform(fold, lambda x: x["row"])).alias("row")).select("doc_id", "row.*").select(*rows.columns)


def aligned(rows: DataFrame) -> DataFrame:
    return rows.select(*DETECTION_COLUMNS)
