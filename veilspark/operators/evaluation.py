"""Precision and recall against a list of expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(value: Column) -> Column:
    """Lower case, without a leading +91 and without blanks, dashes, brackets and dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"^\+91", ""), r"[\s\-().]", "")


def _values(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "detection_type", normal(F.col("text")).alias("value")).distinct()


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall of each type; sets of (type, value) in each document. 1.0 where nothing counts."""
    both = _values(found).withColumn("f", F.lit(1)).join(_values(truth).withColumn("t", F.lit(1)), ["doc_id", "detection_type", "value"], "full")
    n = lambda c: F.sum(c.cast("bigint"))
    tp, fp, fn = n(F.col("f").isNotNull() & F.col("t").isNotNull()), n(F.col("t").isNull()), n(F.col("f").isNull())
    out = both.groupBy("detection_type").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    rate = lambda miss: F.when(F.col("tp") + F.col(miss) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(miss)))
    return out.withColumns({"precision": rate("fp"), "recall": rate("fn")})


def regressions(now: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Types whose precision or recall fell by more than the tolerance."""
    b = baseline.select("detection_type", F.col("precision").alias("base_precision"), F.col("recall").alias("base_recall"))
    both = b.join(now.select("detection_type", "precision", "recall"), "detection_type", "left").fillna(1.0, ["precision", "recall"])
    return both.filter((F.col("precision") < F.col("base_precision") - tolerance) | (F.col("recall") < F.col("base_recall") - tolerance))


def list_match(found: DataFrame, truth: DataFrame) -> DataFrame:
    """n_matched, n_missed, n_false, recall and precision of each document; every listed value counts, repeats included.
    Values are compared without blanks, dashes and +91, in lower case."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "[ -]", ""), r"\+91", ""))
    bag = lambda df, n: df.select("doc_id", "detection_type", plain(F.col("text")).alias("value")).groupBy("doc_id", "detection_type", "value").agg(F.count(F.lit(1)).alias(n))
    both = bag(truth, "t").join(bag(found, "f"), ["doc_id", "detection_type", "value"], "full")
    total = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    known, hit = F.col("t").isNotNull(), F.col("f").isNotNull()
    out = both.groupBy("doc_id").agg(total("t", known & hit).alias("n_matched"), total("t", ~hit).alias("n_missed"), total("f", ~known).alias("n_false"), total("f", hit).alias("n_found"))
    share = lambda n: F.when(n == 0, 1.0).otherwise(F.col("n_matched") / n)
    return out.select("doc_id", "n_matched", "n_missed", "n_false", share(F.col("n_matched") + F.col("n_missed")).alias("recall"), share(F.col("n_found")).alias("precision"))


def expectations_met(diagnostics: DataFrame, elements: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, passed, failures: each expected document against its diagnostics and its number of layout elements.

    ``expected``: doc_id, pipeline, min_pages, has_text, encrypted, min_quality, min_elements; a null asks for nothing. A
    document without diagnostics fails."""
    n = elements.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_elements_"))
    rows = expected.join(diagnostics, "doc_id", "left").join(n, "doc_id", "left").withColumn("n_elements_", F.coalesce("n_elements_", F.lit(0)))
    say = lambda what, want, got: F.concat(F.lit(what + ": expected "), want.cast("string"), F.lit(", got "), got.cast("string"))
    # Spark writes 0.0001 as 1.0E-4
    score = F.when((F.col("overall_score") > 0) & (F.col("overall_score") < 0.001), F.rtrim(F.col("overall_score").cast("decimal(30,18)").cast("string"), F.lit("0"))).otherwise(F.col("overall_score").cast("string"))
    at_least = lambda c: F.concat(F.lit(">= "), F.col(c).cast("string"))
    checks = [
        (F.col("pipeline") != F.col("recommendation"), say("pipeline", F.col("pipeline"), F.col("recommendation"))),
        (F.col("page_count") < F.col("min_pages"), say("pages", at_least("min_pages"), F.col("page_count"))),
        (F.col("has_text") != F.col("has_native_text"), say("text", F.col("has_text"), F.col("has_native_text"))),
        (F.col("encrypted") != F.col("is_encrypted"), say("encrypted", F.col("encrypted"), F.col("is_encrypted"))),
        (F.col("overall_score") < F.col("min_quality"), say("quality", at_least("min_quality"), score)),
        (F.col("n_elements_") < F.col("min_elements"), say("layout", at_least("min_elements"), F.col("n_elements_"))),
    ]
    missing = F.when(F.col("page_count").isNull(), F.lit("no diagnostics"))
    failures = F.array_compact(F.array(missing, *(F.when(bad, text) for bad, text in checks)))
    return rows.select("doc_id", (F.size(failures) == 0).alias("passed"), failures.alias("failures"))
