"""Line removal with two Bloom filters: lines seen once, lines seen twice.

Each task puts the hashes of its documents' distinct lines in a filter of lines seen and, where one is there already, in
a filter of lines seen twice. Merging two tasks' filters marks as seen twice what either has twice or both have once, so
the merged second filter holds every line that two documents share, and few others. Only lines in it ("suspected") are
shuffled; they are then counted exactly, one row for each key and document, and the keys found in ``min_docs`` documents
lose their lines: all of them, or all but the first occurrence (the lowest document id, then the lowest line).

The filters have about 8 bits for each line of the table, at least 2**20 and at most 2**28 bits (``filter_bits``), so that
what the driver merges and broadcasts is bounded: a fuller filter lets more unrepeated lines through to the exact count
and never changes the result. Keys in the exact count are 128-bit hashes of the whole key.

Edge cases: a null or empty text is one empty line; lines are split at \\n only; a key is the line without
``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; keys shorter than ``min_chars`` code points never go;
documents are told apart by doc_id, so repeated rows of one id count once; all rows without an id count as one document.
Lines go row by row: rows that share an id, or have none, each lose their own repeated lines and no others (a row is known
by its id and 128 bits of its text's hashes; rows equal in both are equal). With ``keep_first``, each row of the first
document keeps the line's first place. An empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut, fresh, prepare, raw_texts

_BLANK = b" \t\n\x0b\x0c\r"
WORDS = 1 << 12  # 64-bit words in a slice of a filter
BITS = 4  # bits set for a key, all in one word


class TwiceFilter:
    """Blocked Bloom filters in 64-bit words: ``once`` holds what was added, ``twice`` what was added again."""

    def __init__(self, log2_bits: int):
        self.words = 1 << (log2_bits - 6)
        self.once, self.twice = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and bits for each 64-bit hash."""
        h = h.astype(np.uint64)
        where = (h >> np.uint64(24)) & np.uint64(self.words - 1)
        mask = np.zeros(len(h), np.uint64)
        for k in range(BITS):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
        return where.astype(np.int64), mask

    def add(self, h: np.ndarray) -> None:
        """Add hashes: those there already, and those twice among the new, count as seen twice."""
        h, n = np.unique(h, return_counts=True)
        where, mask = self.places(h)
        again = ((self.once[where] & mask) == mask) | (n > 1)
        np.bitwise_or.at(self.twice, where[again], mask[again])
        np.bitwise_or.at(self.once, where, mask)

    def suspected(self, h: np.ndarray) -> np.ndarray:
        where, mask = self.places(h)
        return (self.twice[where] & mask) == mask

    def slices(self) -> Iterator[tuple[int, bytes]]:
        """Slices that aren't empty, compressed: once, then twice."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(0, self.words, WORDS):
            if self.once[k : k + WORDS].any():
                yield k // WORDS, pack(self.once[k : k + WORDS].tobytes() + self.twice[k : k + WORDS].tobytes())


def merge_into(once: np.ndarray, twice: np.ndarray, other: np.ndarray) -> None:
    """Merge another task's slice (once, then twice) into this one."""
    n = len(once)
    twice |= other[n:] | (once & other[:n])
    once |= other[:n]


def keys_of(text: bytes) -> list[bytes]:
    return [x.strip(_BLANK).lower() for x in text.split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


FILTERS = "slice bigint, part bigint, packed binary"


def task_filters(docs: DataFrame, min_chars: int, log2_bits: int) -> DataFrame:
    """Each task's filters in slices. ``part`` deals them for merging; it follows from the task's number alone, so that a
    task that runs again sends its slices where they went before."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TwiceFilter(log2_bits)
        for batch in batches:
            hashes: list[int] = []
            for text in raw_texts(batch):
                hashes.extend(xxhash.xxh3_64_intdigest(k) for k in set(keys_of(text)) if _long_enough(k, min_chars))
            own.add(np.array(hashes, np.uint64))
        part = TaskContext.get().partitionId() % 64
        for k, packed in own.slices():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part], pa.int64()), pa.array([packed], pa.binary())], names=["slice", "part", "packed"])

    return docs.select("text").mapInArrow(gather, FILTERS)


def twice_seen(docs: DataFrame, min_chars: int, log2_bits: int) -> np.ndarray:
    """The merged filter of lines seen twice: 2**log2_bits bits, whatever the input. Merged in two rounds by slice."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slice; one slice is held at a time."""
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        now, once, twice = None, np.zeros(WORDS, np.uint64), np.zeros(WORDS, np.uint64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([pack(once.tobytes() + twice.tobytes())], pa.binary())], names=["slice", "part", "packed"])

        for batch in batches:
            for k, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (k, part):
                    if now is not None:
                        yield out()
                    now = (k, part)
                    once[:], twice[:] = 0, 0
                merge_into(once, twice, np.frombuffer(unpack(packed), np.uint64))
        if now is not None:
            yield out()

    first = task_filters(docs, min_chars, log2_bits).repartition("slice", "part").sortWithinPartitions("slice", "part").mapInArrow(merge, FILTERS)
    second = first.withColumn("part", F.lit(0).cast("bigint")).repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, FILTERS)
    import zstandard

    whole = np.zeros(1 << (log2_bits - 6), np.uint64)
    for row in second.select("slice", "packed").toLocalIterator():  # 2**log2_bits bits in all, a slice at a time
        whole[row[0] * WORDS : (row[0] + 1) * WORDS] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row[1]), np.uint64)[WORDS:]
    return whole


def filter_bits(docs: DataFrame, least: int = 20, most: int = 28) -> int:
    """The filters' size for a table, as a power of two: 8 bits a line, between bounds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return min(most, max(least, (8 * n - 1).bit_length()))


def row_hashes() -> list[Column]:
    """128 bits that tell the rows of one id apart by their texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, log2_bits: int | None = None, keep_first: bool = False) -> DataFrame:
    """doc_id, h1, h2, drop (array of line numbers from 0): the lines that go, for rows that lose any."""
    spark = prepare(docs.sparkSession)
    seen = spark.sparkContext.broadcast(twice_seen(docs, min_chars, log2_bits or filter_bits(docs)))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TwiceFilter(6)
        own.words, own.twice = len(seen.value), seen.value
        for batch in batches:
            of, keys, at = [], [], []
            for row, text in enumerate(raw_texts(batch)):
                lines: dict[bytes, list[int]] = {}
                for i, k in enumerate(keys_of(text)):
                    if _long_enough(k, min_chars):
                        lines.setdefault(k, []).append(i)
                of.extend([row] * len(lines))
                keys.extend(lines)
                at.extend(lines.values())
            if not keys:
                continue
            hit = np.flatnonzero(own.suspected(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)))
            rows = pa.array([of[i] for i in hit], pa.int64())
            new = [pa.array([xxhash.xxh3_128_digest(keys[i]) for i in hit], pa.binary()), pa.array([at[i] for i in hit], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(3)), *new], names=["doc_id", "h1", "h2", "line_key", "at"])

    h1, h2 = row_hashes()
    found = cut(docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text").mapInArrow(suspects, "doc_id bigint, h1 bigint, h2 bigint, line_key binary, at array<int>"), "suspects")
    # One row for each key and document id: rows of one id count once.
    per_doc = found.groupBy("line_key", "doc_id").agg(F.count(F.lit(1)).alias("rows_"))
    often = per_doc.groupBy("line_key").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first_doc")).filter(F.col("n_docs") >= min_docs)
    often = cut(often, "often")  # written, so that its size is known to the join and a hot key's rows can be split
    gone = found.join(often, "line_key")
    if keep_first:
        first = F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("first_doc")
        gone = gone.withColumn("at", F.when(first, F.expr("slice(at, 2, greatest(size(at) - 1, 0))")).otherwise(F.col("at")))
    return gone.filter(F.size("at") > 0).groupBy("doc_id", "h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("drop"))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, log2_bits: int | None = None, keep_first: bool = False) -> DataFrame:
    """The documents with ``text`` without the repeated lines, ``n_lines`` (before) and ``n_dropped``."""
    drop, cells = fresh(docs, "drop"), fresh(docs, "cells")
    gone = repeated_lines(docs, min_docs, min_chars, log2_bits, keep_first).select(F.col("doc_id").alias(drop + "id"), F.col("h1").alias(drop + "h1"), F.col("h2").alias(drop + "h2"), F.col("drop").alias(drop))
    h1, h2 = row_hashes()
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[drop + "id"]) & (h1 == gone[drop + "h1"]) & (h2 == gone[drop + "h2"]), "left")
    joined = joined.withColumn(cells, F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    names = [fresh(docs, "n_lines"), fresh(docs, "n_dropped")]
    stay = F.array_except(F.sequence(F.lit(0), F.size(cells) - 1), F.col(drop))  # by a hash set: long documents have many lines
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(cells), i)), "\n")
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept)
    n_dropped = F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("bigint")
    return joined.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), F.size(cells).cast("bigint").alias(names[0]), n_dropped.alias(names[1]))


def digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, log2_bits: int | None = None) -> DataFrame:
    out = drop_lines(docs.select("doc_id", "text"), min_docs, min_chars, log2_bits)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, p, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(often.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often ON k.key = often.key GROUP BY doc_id
"""
