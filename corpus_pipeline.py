"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, SentencePiece.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns their columns; the last
adds ``token_ids``, ``n_tokens`` and ``round_trip`` (whether the decoded ids give the text). Stages:

1. quality_rules: documents that fail the rules, and those of rejected hosts, go.
2. line_dedup: lines found in 10 documents or more stay only where they occur first; ``n_chars`` follows the text, and
   documents that lose all their words this way go (null and empty texts that had none stay).
3. near_dedup: five-word shingles, similarity 0.8; the smallest doc_id of each group stays.
4. decontaminate: documents that hold a benchmark item, give or take 8 % of its characters, go.
5. sentencepiece: unigram Viterbi ids of the whole text.

``ORACLE_SQL`` is None: SQL cannot say stages 3 to 5; tests compare the pipeline with brute force on a fixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate as benchmark
from veilspark.llm import host_rules, line_dedup, near_dups, queries, unigram
from veilspark.llm.common import cut, fresh, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    had = fresh(docs, "had_words")
    word = r"[^\x20\x09-\x0D]"
    out = line_dedup.drop_lines(docs.withColumn(had, F.coalesce(F.col("text").rlike(word), F.lit(False))), min_docs=10, keep_first=True)
    out = out.filter(~F.col(had) | F.col("text").rlike(word))
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.first_of_each(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = unigram.encode_frame(docs, queries.pieces())
    ids, n, decoded = out.columns[-3:]
    return out.select(*docs.columns, ids, n, (F.col(decoded) == F.coalesce("text", F.lit(""))).alias(fresh(docs, "round_trip")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
