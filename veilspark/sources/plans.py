"""Review plans and workspace terms as JSON, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.schema import BBOX

ENTRY = f"detection_id string, detector_name string, detection_type string, text string, page_number int, block_ord int, `start` int, `end` int, bbox {BBOX}, confidence double, reasons array<string>, suggested_action string, suggestion_reason string, decision string"
PLAN = f"schema_version int, doc_id bigint, source_path string, source_sha256 string, policy_name string, entries array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in ENTRY.split(', '))}>>"


def to_json(entries: DataFrame, policy_name: str) -> DataFrame:
    """doc_id, plan: one JSON text per document. Needs source_path and source_sha256 in the entries."""
    columns = [c.strip().split(" ")[0].strip("`") for c in ENTRY.split(", ")]
    one = F.struct("entry_ord", F.struct(*columns).alias("e"))
    plan = F.struct(F.lit(1).alias("schema_version"), F.col("doc_id"), F.first("source_path").alias("source_path"), F.first("source_sha256").alias("source_sha256"), F.lit(policy_name).alias("policy_name"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias("entries"))
    return entries.groupBy("doc_id").agg(F.to_json(plan).alias("plan"))


def from_json(plans: DataFrame) -> DataFrame:
    """Entries of plans (column plan); a text that is no plan gives none."""
    p = plans.select(F.from_json("plan", PLAN).alias("p")).filter(F.col("p.doc_id").isNotNull())
    return p.select("p.doc_id", "p.source_path", "p.source_sha256", "p.policy_name", F.posexplode("p.entries").alias("entry_ord", "e")).select("doc_id", "source_path", "source_sha256", "policy_name", "entry_ord", "e.*")


def write(entries: DataFrame, policy_name: str, path: str) -> None:
    to_json(entries, policy_name).select(F.col("plan").alias("value")).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return from_json(spark.read.text(path).withColumnRenamed("value", "plan"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a store; what is broken is left out."""
    raw = spark.read.schema("term string, label string, case_sensitive boolean, added_from string, ignored boolean").option("mode", "DROPMALFORMED").json(path)
    return raw.filter(F.col("term").isNotNull() & F.col("label").isNotNull()).fillna(False, ["case_sensitive", "ignored"])


def write_terms(terms: DataFrame, path: str) -> None:
    terms.write.mode("overwrite").json(path)
