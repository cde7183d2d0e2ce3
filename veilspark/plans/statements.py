"""Account statements made from the customer table, so that every detector and stage has rows to work on.

The expressions below are read alike by Spark and by DuckDB; each is one block of a customer's two-page document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.geometry import box

_pad = lambda x, n: f"lpad(CAST(({x}) AS STRING), {n}, '0')"
_pick = lambda by, *xs: f"CASE (k % {len(xs)}) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"

FIELDS = {
    "given": _pick(5, "'Maya'", "'Arjun'", "'Leena'", "'Rohan'", "'Kavya'"),
    "family": _pick(4, "'Kulkarni'", "'Deshmukh'", "'Banerjee'", "'Pillai'"),
    "mobile": f"'9' || {_pad('k * 7919 % 1000000000', 9)}",
    "aadhaar": f"'2' || {_pad('k * 104729 % 100000000000', 11)}",
    "bank": _pick(5, "'SBIN'", "'HDFC'", "'UTIB'", "'ICIC'", "'ZZZZ'"),
    "account": "CAST(40000000000 + k * 7919 AS STRING)",
}
BLOCKS = [
    "CASE WHEN k % 3 = 0 THEN given || ' ' || family ELSE 'Monthly statement of account' END",
    "'Email: ' || lower(given) || '.' || lower(family) || '@example.com' || CASE WHEN k % 4 = 0 THEN 'Phone' ELSE '' END || ' or github.com/' || given || family",
    f"'PAN: ABC' || {_pick(4, repr('P'), repr('C'), repr('Q'), repr('F'))} || 'X' || {_pad('k % 10000', 4)} || 'Z'",
    f"'IFSC: ' || bank || '0' || {_pad('k % 1000000', 6)}",
    "'Account Number: ' || account",
    "'Mobile: ' || mobile",
    f"'UTR: 7' || {_pad('k * 31 % 1000000000', 9)}",
    f"'UPI/DR/' || {_pad('k * 97 + 200000000000', 12)} || '/PAYEE ' || account",
    f"lower(given) || CAST(k AS STRING) || '@' || {_pick(4, repr('ybl'), repr('okaxis'), repr('shopx'), repr('YBL'))} || ' paid to shop@mart.in'",
    "'Account Number'",
    f"': ' || {_pad('k * 99991 + 500000000000000', 15)}",
    f"'0097737' || {_pad('k % 1000000', 6)} || ' AT 30524'",
    "'Aadhaar No: ' || aadhaar",
    "'Copy ' || substr(aadhaar, 1, 4) || ' ' || substr(aadhaar, 5, 4) || '-' || substr(aadhaar, 9, 4)",
    "'Call ' || substr(mobile, 1, 5) || ' ' || substr(mobile, 6, 5) || ' or +91' || mobile || ' or 0' || mobile",
    "'Statement Period: 01 Apr 2024 to 31 Mar 2025'",
    "'Account Holder: ' || given || ' ' || family",
    f"{_pick(5, repr('State Bank of India'), repr('HDFC Bank'), repr('Axis Bank'), repr('ICICI Bank'), repr('Credit union'))} || ' branch'",
    f"'Ref ID: 8' || {_pad('k * 17 % 1000000000', 9)} || ' order ' || account",
    f"'Balance carried forward ' || {_pad('k * 13 % 100000000000000 + 10000000000000', 14)}",
    "CASE WHEN k % 2 = 0 THEN '2' ELSE 'page two' END",
]
ON_FIRST_PAGE = 12
WIDTH, HEIGHT = 595.0, 842.0
_Y0 = f"(CASE WHEN block_ord = 1 THEN 30.0 WHEN block_ord = {len(BLOCKS)} THEN 800.0 ELSE 100.0 + 14.0 * ((block_ord - 1) % {ON_FIRST_PAGE}) + CASE WHEN (block_ord - 1) % {ON_FIRST_PAGE} > 5 THEN 40.0 ELSE 0.0 END END)"
_PAGE = f"(CASE WHEN block_ord <= {ON_FIRST_PAGE} THEN 1 ELSE 2 END)"
_FIELDS = ", ".join(f"{x} AS {n}" for n, x in FIELDS.items())


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    # Each key becomes a document of many blocks: dealt by key first, the work is spread and stays together by document.
    customer = customer.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")
    fields = customer.selectExpr("k", *(f"{x} AS {n}" for n, x in FIELDS.items()))
    rows = fields.select(F.col("k").alias("doc_id"), F.posexplode(F.array(*(F.expr(x) for x in BLOCKS))).alias("pos", "text")).withColumn("block_ord", F.col("pos") + 1)
    y0 = F.expr(_Y0).cast("double")
    return rows.select("doc_id", F.expr(_PAGE).cast("int").alias("page_number"), F.col("block_ord").cast("int").alias("block_ord"), F.lit("text").alias("block_type"), "text", box(F.lit(50.0), y0, F.lit(50.0) + F.length("text") * 6.0, y0 + 14.0).alias("bbox"))


def pages(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "page_number").distinct().withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


#: The same blocks for DuckDB: doc_id, page_number, block_ord, text, x0, y0, x1, y1.
SQL = f"""s AS (
  SELECT doc_id, {_PAGE} AS page_number, block_ord, text, 50.0::DOUBLE AS x0, {_Y0}::DOUBLE AS y0, 50.0::DOUBLE + length(text) * 6.0::DOUBLE AS x1, {_Y0}::DOUBLE + 14.0::DOUBLE AS y1
  FROM (SELECT k AS doc_id, generate_subscripts(b, 1)::INT AS block_ord, unnest(b) AS text
        FROM (SELECT k, [{", ".join(BLOCKS)}] AS b FROM (SELECT k, {_FIELDS} FROM (SELECT c_custkey AS k FROM customer)))))"""
