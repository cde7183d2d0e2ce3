"""What the corpus operators share: reading tables, scratch tables in the shared folder, Arrow settings."""

from __future__ import annotations

import uuid
import zlib
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, ``[\x20\x09-\x0D]``; bytes.split() and bytes.strip() use just these.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 256, size: int = 4 << 20) -> SparkSession:
    """Bound Arrow batches by rows and bytes, so that a few very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one beside the warehouse where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "-scratch"
    path = f"{base.rstrip('/')}/veilspark/{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete this process's scratch tables. Call it when all results that were built on them have been written."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: later jobs don't repeat the work, a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def uncut(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once all that was built on them has been written itself."""
    for df in tables:
        _delete(df.sparkSession, _paths.pop(df))


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def py_crc_mod(doc_id: int | None, by: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % by


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (Spark compares names without regard to case)."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name
