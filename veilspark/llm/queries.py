"""The queries of the corpus operators, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, host_rules, id_blocks, language_id, line_dedup, near_dups, suffix_tree_lm, token_counts, unigram, warc
from veilspark.llm.common import table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def pieces() -> unigram.Pieces:
    return unigram.Pieces.from_model(tokenizer("piece_bpe_32k.model"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.digest(table(spark, sf_dir, "documents"), pieces())


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.assess(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_blocks.store_and_read(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.link(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


QUERIES = {
    "op1_decontamination": op1,
    "op2_token_counts": op2,
    "op3_sentencepiece": op3,
    "op4_lm_score": op4,
    "op5_language": op5,
    "op6_quality_rules": op6,
    "op7_token_ids": op7,
    "op8_near_dups": op8,
    "op9_warc": op9,
    "op10_line_dedup": op10,
}
ORACLES = {"op6_quality_rules": host_rules.SQL, "op8_near_dups": near_dups.SQL, "op9_warc": warc.SQL, "op10_line_dedup": line_dedup.SQL}
