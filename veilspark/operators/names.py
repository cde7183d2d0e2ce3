"""Person names from a document's own evidence: e-mail local parts, profile handles, a title line.

Tokens with their kinds of evidence are small tables keyed by (document, token); that a handle holds an address's token is
an equi-join of the token with the handle's parts. Tokens meet the blocks by an equi-join too, with what stands between
camel-case edges in runs of letters; only blocks that hold one are searched for its places. Documents without a live
token go no further.

Evidence: parts of an address before any ``+``, between ``[._%0-9-]`` ("email"); camel-case parts of a handle, a handle of
letters alone, and an address's token inside a handle ("handle"); a handle of letters around an address's token ("email"
too); words of the title line, which is the first of the first page's first three blocks with two to four capitalised words
in at most 40 characters ("title"). Two kinds give 0.9, one gives 0.6, a title alone nothing. Tokens have four letters or
more, no digits, and are no stop words. A match begins and ends at a non-letter or at a camel-case edge; one within a
longer one of its block is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import lexicon as lx
from veilspark.functions.geometry import range_box
from veilspark.functions.spans import after, before, cut_out, spans_of
from veilspark.schema import DETECTION_COLUMNS

HIGH, SINGLE = 0.9, 0.6
SHORTEST = 4
CAMEL = r"(?<=\p{Ll})(?=\p{Lu})"
TITLE = r"^\p{Lu}\p{L}*(\s+\p{Lu}\p{L}*){1,3}$"
PLACE = ("page_number", "block_ord", "nth")


def _matches(blocks: DataFrame, pattern: str, name: str) -> DataFrame:
    """doc_id, ``name`` and its place, for every match of the pattern's group."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("nth", name)
    return blocks.select("doc_id", "page_number", "block_ord", found)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter((F.length("token") >= SHORTEST) & F.col("token").rlike(r"^\p{L}+$") & ~F.col("token").isin(lx.NOT_NAMES))


def email_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, token, raw (the local part), place."""
    rows = _matches(blocks.filter(F.col("text").contains("@")), lx.EMAIL_LOCAL, "local").withColumn("raw", F.substring_index("local", "+", 1))
    part = F.explode(F.split("raw", r"[._\-%0-9]+"))
    return _usable(rows.select("doc_id", *PLACE, "raw", part.alias("token")).withColumn("token", F.lower("token")))


def handles(blocks: DataFrame) -> DataFrame:
    """doc_id, raw (the handle), slug (in lower case), place."""
    hint = F.lower("text").rlike(r"linkedin\.com/in/|github\.com/")
    return _matches(blocks.filter(hint), f"(?i){lx.PROFILE}", "raw").withColumn("slug", F.lower("raw"))


def camel_tokens(found: DataFrame) -> DataFrame:
    part = F.explode(F.regexp_extract_all("raw", F.lit("[A-Z][a-z]{2,}"), F.lit(0)))
    return _usable(found.select("doc_id", *PLACE, "raw", part.alias("token")).withColumn("token", F.lower("token")))


def title_words(blocks: DataFrame) -> DataFrame:
    """doc_id, token, line: words of the title line."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "block_ord")
    top = blocks.select("doc_id", "page_number", "block_ord", "text").withColumn("nth", F.row_number().over(order)).filter("nth <= 3")
    line = F.regexp_replace("text", r"^\s+|\s+$", "")
    first = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "page_number", line.alias("line")))).alias("top"))
    fits = lambda x: (x["page_number"] == F.col("top")[0]["page_number"]) & (F.length(x["line"]) <= 40) & x["line"].rlike(TITLE)
    lines = first.select("doc_id", F.get(F.filter("top", fits), F.lit(0))["line"].alias("line")).filter("line IS NOT NULL")
    word = F.lower(F.replace("token", F.lit("ß"), F.lit("ss")))
    return _usable(lines.select("doc_id", "line", F.explode(F.split("line", r"\s+")).alias("token")).withColumn("token", word))


def evidence(blocks: DataFrame) -> DataFrame:
    """doc_id, token, confidence, reasons: the live tokens."""
    key, place = ["doc_id", "token"], F.struct(*PLACE)
    mails = email_tokens(blocks).groupBy(*key).agg(F.min_by("raw", place).alias("mail"))
    found = handles(blocks)
    slugs = found.groupBy("doc_id", "slug").agg(F.min(place).alias("at"), F.min_by("raw", place).alias("raw"))
    camel = camel_tokens(found).groupBy(*key).agg(F.min_by("raw", place).alias("camel"))
    whole = _usable(slugs.select("doc_id", F.col("slug").alias("token"), "at", "raw"))
    # every part of a handle that could be an address's token
    starts = F.sequence(F.lit(1), F.length("slug") - SHORTEST + 1)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(SHORTEST), F.length("slug") - i + 1), lambda n: F.substring("slug", i, n))))
    inside = slugs.filter(F.length("slug") > SHORTEST).select("doc_id", "slug", "at", "raw", F.explode(F.array_distinct(parts)).alias("token")).filter("token <> slug").join(mails, key)
    held = inside.groupBy(*key).agg(F.min(F.struct("at", "raw")).alias("held"))
    lent = inside.groupBy("doc_id", F.col("slug").alias("token")).agg(F.min("token").alias("lent"))
    own = whole.groupBy(*key).agg(F.min(F.struct("at", "raw")).alias("own"))
    rows = mails.join(camel, key, "full").join(own, key, "full").join(held, key, "left").join(lent, key, "left")
    titles = title_words(blocks.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")).groupBy(*key).agg(F.first("line").alias("line"))
    rows = rows.join(titles, key, "left")
    say = lambda a, c, b="'": F.concat(F.lit(a), c, F.lit(b))
    as_own = F.col("own.raw").isNotNull() & (F.col("held.at").isNull() | (F.col("own.at") < F.col("held.at")))
    by_handle = F.when(F.col("camel").isNotNull(), say("derived from profile handle '", F.col("camel"))).when(as_own, say("profile handle '", F.col("own.raw"))).when(F.col("held.raw").isNotNull(), say("contained in profile handle '", F.col("held.raw")))
    by_mail = say("derived from email local part '", F.col("mail"))
    by_lent = F.when(F.col("own.raw").isNotNull(), say("contains email-derived token '", F.col("lent")))
    notes = F.when(F.col("mail").isNotNull(), F.array(by_mail, by_handle)).otherwise(F.array(by_handle, by_lent))
    reasons = F.array_compact(F.concat(notes, F.array(say("appears in the title line '", F.col("line")))))
    return rows.select(*key, F.when(F.size(reasons) > 1, HIGH).otherwise(SINGLE).alias("confidence"), reasons.alias("reasons"))


def stretches(text: Column, longest: Column) -> Column:
    """What stands between camel-case edges or ends of runs of letters, in lower case, up to about ``longest`` characters."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}{4,}"), F.lit(0)))

    def of_run(run: Column) -> Column:
        parts = F.split(run, CAMEL)
        last = F.size(parts)
        # all parts but the first and the last have two letters or more
        upto = lambda i: F.least(last - i + 1, (longest / 2).cast("int") + 2)
        return F.flatten(F.transform(F.sequence(F.lit(1), last), lambda i: F.transform(F.sequence(F.lit(1), upto(i)), lambda n: F.concat_ws("", F.slice(parts, i, n)))))

    whole = F.filter(runs, lambda r: ~r.rlike(CAMEL))
    cut = F.flatten(F.transform(F.filter(runs, lambda r: r.rlike(CAMEL)), of_run))
    return F.array_distinct(F.transform(F.concat(whole, cut), lambda x: F.lower(x)))


def scan_names(blocks: DataFrame, detector_ord: int = 7, values_only: bool = False) -> DataFrame:
    """NAME detections; with ``values_only`` and a column ``words``, boxes fit the name."""
    text = blocks.filter((F.col("block_type") == "text") & F.col("text").isNotNull())
    live = evidence(text)
    longest = live.groupBy("doc_id").agg(F.max(F.length("token")).alias("longest"))
    at = ["doc_id", "page_number", "block_ord"]
    words = text.join(longest, "doc_id").select(*at, F.explode(stretches(F.col("text"), F.col("longest"))).alias("token"))
    hit = words.join(live, ["doc_id", "token"]).groupBy(*at).agg(F.collect_list(F.struct("token", "confidence", "reasons")).alias("tokens"))
    boxed = values_only and "words" in blocks.columns
    rows = text.select(*at, "bbox", F.col("text").alias("whole"), *(["words"] if boxed else [])).join(hit, at).withColumn("t", F.explode("tokens"))
    rows = rows.withColumn("s", F.explode(spans_of(F.col("whole"), F.concat(F.lit("(?i)"), F.col("t.token")))))
    a, b = F.col("s.start"), F.col("s.end")
    left, right = F.substring(before(F.col("whole"), a), -1, 1), F.substring(after(F.col("whole"), b), 1, 1)
    first, end = F.substring(F.col("s.value"), 1, 1), F.substring(F.col("s.value"), -1, 1)
    edge = lambda x, y: x.rlike(r"^\p{Ll}$") & y.rlike(r"^\p{Lu}$")
    free = (~left.rlike(r"^\p{L}$") | edge(left, first)) & (~right.rlike(r"^\p{L}$") | edge(end, right))
    order = Window.partitionBy(*at).orderBy(a, b.desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.filter(free).withColumn("reach", F.max(b).over(order)).filter(F.col("reach").isNull() | (F.col("reach") < b))
    box = range_box(F.col("whole"), F.col("words"), F.col("bbox"), a, b) if boxed else F.col("bbox")
    values = {"detector_name": F.lit("name"), "detector_ord": F.lit(detector_ord), "detection_type": F.lit("NAME"), "text": cut_out(F.col("whole"), a, b), "start": a, "end": b, "bbox": box, "confidence": F.col("t.confidence"), "reasons": F.col("t.reasons"), "pattern_ord": F.lit(0)}
    return kept.select(*(values[c].alias(c) if c in values else F.col(c) for c in DETECTION_COLUMNS))


def candidates(blocks: DataFrame) -> DataFrame:
    """doc_id, token, source: tokens from e-mail local parts and camel-case handles."""
    text = blocks.filter(F.col("block_type") == "text")
    mails = email_tokens(text).select("doc_id", "token", F.lit("email").alias("source"))
    return mails.unionByName(camel_tokens(handles(text)).select("doc_id", "token", F.lit("handle").alias("source"))).distinct()
