"""Token ids in a binary block format, with a zstandard dictionary that all blocks share.

Documents are dealt into ranges of ascending doc_id. Within a range each document's ids (little-endian u32, the end id
last) are one zstandard frame of their own, compressed with a dictionary trained on the serialized id arrays of a
bounded sample (``dict_docs`` documents chosen by hash, up to ``dict_chars`` characters of each). Where the trainer finds
the sample too small, the sample itself is the dictionary; only a table without a row has none. A block holds some
thousand documents:

    b"VSID" | u32 version | 32 bytes sha256 of the dictionary | u64 documents | u64 ids before the block in its range |
    index: documents x (i64 doc_id, u64 first id in the block, u64 frame offset, u32 ids, u32 doc_id is null) | frames

so one document is read by two lookups in the index and the decoding of one frame. Blocks are rows of a Parquet table in
the shared folder, so any store that Spark writes to will do, and a task that is run again replaces its own rows.

Edge cases: a null or empty text is the end id alone; documents with the same doc_id stand next to each other, in order
of their text's hash; a null doc_id comes first; special strings in a text (such as the end-of-text mark) are handled as
the library does by default; an empty table gives no blocks; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut, prepare

MAGIC, VERSION = b"VSID", 1
HEAD = struct.Struct("<4sI32sQQ")
INDEX = np.dtype([("doc_id", "<i8"), ("first", "<u8"), ("offset", "<u8"), ("n", "<u4"), ("null", "<u4")])


MARKS = ".,;:"
#: A word of letters of ASCII, Latin-1 and Latin Extended, a blank before it or not, a mark after it or not.
LETTERS = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[.,;:]?$"


class ByteEncoder:
    """Ids of a byte-level BPE tokenizer. Words repeat: between visible characters, a blank always starts a new pre-token and
    a newline is one of its own, so texts are cut there, and each distinct part goes to the library once. Texts where
    white space meets white space or the text's edge, or with an added token's string, go to the library whole.

    Cutting, numbering the distinct parts and putting ids together are array operations; only distinct parts of a batch
    become objects."""

    def __init__(self, path: str, most: int = 96 << 20):
        """most: bytes that the store of known parts may take, counted part by part."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        self.cuttable = conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and conf["model"]["type"] == "BPE" and not conf["model"].get("dropout")
        self.special = [x["content"] for x in conf.get("added_tokens", [])]
        self.most = most
        self.model = self.tok.model
        self.table = byte_letters()
        self.marks = np.frombuffer(b"".join(self.whole(list(MARKS))), np.uint32) if self.cuttable else np.zeros(0, np.uint32)
        self.mark_of = np.zeros(256, np.uint8)  # a mark's number, from 1, by its byte
        self.mark_of[list(MARKS.encode())] = np.arange(1, len(MARKS) + 1)
        self.forget()

    def forget(self) -> None:
        """Drop what was learnt."""
        self.parts: dict[str, bytes] = {}  # ids of a word or another part; empty for one that must not be cut off
        self.taken = 0

    def whole(self, xs: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(xs, add_special_tokens=False)] if xs else []

    def encode(self, xs: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian u32; null as empty."""
        column = pc.fill_null(xs if isinstance(xs, pa.Array) else pa.array(xs, pa.string()), "")
        if not self.cuttable or not len(column):
            return self.whole(column.to_pylist())
        rest = pc.match_substring(column, "\x00").to_numpy(zero_copy_only=False).copy()
        for s in self.special:
            rest |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        # newlines alone, every other part but the first with the blank before it
        marked = pc.replace_substring(pc.replace_substring(column, " ", "\x00 "), "\n", "\x00\n\x00")
        lists = pc.split_pattern(marked, "\x00")
        first = lists.offsets.to_numpy()
        numbered = lists.flatten().dictionary_encode()
        codes = numbered.indices.to_numpy()
        ids, at, size, mark = self._ids_of(numbered.dictionary)
        n = size[codes]
        rest |= np.add.reduceat(n == 0, first[:-1]) > 0
        end = np.cumsum(n)
        kind = np.int32 if end[-1] < 1 << 31 and len(ids) < 1 << 31 else np.int64
        place = np.repeat((at[codes] - (end - n)).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        marked = np.flatnonzero(mark[codes])
        place[end[marked] - 1] = len(ids) - len(self.marks) - 1 + mark[codes[marked]].astype(kind)
        flat = ids[place]
        edge = np.concatenate([[0], end])[first]
        out = [b"" if r else flat[a:b].tobytes() for r, a, b in zip(rest.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        again = np.flatnonzero(rest)
        for i, x in zip(again.tolist(), self.whole([column[int(i)].as_py() for i in again]), strict=True):
            out[i] = x
        return out

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, and for each part where its ids start there, their number (0: it must not be cut off) and the number of the
        mark that is the last of them (0: none). The marks' ids stand at the end of ids."""
        if self.taken > self.most:
            self.forget()
        # letters, perhaps with one mark after them: pre-tokens that need no searching, straight to the model
        plain = pc.match_substring_regex(parts, LETTERS)
        lettered = parts.filter(plain)
        numbered = pc.utf8_rtrim(lettered, MARKS).dictionary_encode()
        words, rest = numbered.dictionary.to_pylist(), parts.filter(pc.invert(plain)).to_pylist()
        found = self._known(words, self._spelled) + self._known(rest, lambda xs: self.whole([x if _free(x) else "" for x in xs]))
        size_of = np.fromiter(map(len, found), np.int64, len(found)) // 4
        plain = plain.to_numpy(zero_copy_only=False)
        entry = np.empty(len(parts), np.int64)
        entry[plain], entry[~plain] = numbered.indices.to_numpy(), np.arange(len(words), len(found))
        mark = np.zeros(len(parts), np.uint8)
        if len(lettered):
            _, offsets, data = lettered.buffers()
            last = np.frombuffer(offsets, np.int32)[1 : len(lettered) + 1] - 1
            mark[plain] = self.mark_of[np.frombuffer(data, np.uint8)[last]]
        return np.frombuffer(b"".join([*found, self.marks.tobytes()]), np.uint32), (np.cumsum(size_of) - size_of)[entry], size_of[entry] + (mark > 0), mark

    def _known(self, parts: list[str], ids_of: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each part; those not met before go to ``ids_of``."""
        found = list(map(self.parts.get, parts))
        new = [i for i, x in enumerate(found) if x is None]
        own = [parts[i] for i in new]
        self.taken += 200 * len(new) + 8 * sum(map(len, own))  # an entry, its text and its ids, rather too much
        for i, x in zip(new, ids_of(own), strict=True):
            found[i] = x
        self.parts.update(zip(own, map(found.__getitem__, new), strict=True))
        return found

    def _spelled(self, words: list[str]) -> list[bytes]:
        tokenize, ids, end = self.model.tokenize, array("I"), [0]
        for w in words:
            ids.extend([t.id for t in tokenize(("\u0120" + w[1:] if w[0] == " " else w) if w.isascii() else w.encode().decode("latin-1").translate(self.table))])
            end.append(len(ids) * 4)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(end, end[1:], strict=False)]


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _free(part: str) -> bool:
    """Whether a part may be cut off: a newline, or text that neither begins nor ends with white space or a control."""
    if part.isprintable():
        return part not in ("", " ")
    body = part[1:] if part[:1] == " " else part
    return part == "\n" or bool(body) and not any(c.isspace() or not c.isprintable() for c in (body[0], body[-1]))


_ENCODERS: dict[str, ByteEncoder] = {}


@contextmanager
def encoder(path: str) -> Iterator[ByteEncoder]:
    """This process's encoder for a tokenizer file. What it learns in a task goes at the task's end, so that a worker that
    is used again for other work holds the vocabulary alone."""
    own = _ENCODERS[path] = _ENCODERS.get(path) or ByteEncoder(path)
    try:
        yield own
    finally:
        own.forget()
        pa.default_memory_pool().release_unused()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, dict_docs: int = 400, dict_chars: int = 8000, size: int = 64 << 10) -> bytes:
    """A dictionary of at most ``size`` bytes from the id arrays of ``dict_docs`` documents, up to ``dict_chars`` characters
    of each. Too small a sample for the trainer is the dictionary itself, as raw content."""
    h = F.xxhash64(F.col("doc_id"), F.lit(7))
    share = min(1.0, 8 * dict_docs / max(1, docs.count()))  # rows that may be chosen at all: few are sorted
    few = docs.filter(F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30))).select(F.substring("text", 1, dict_chars).alias("text"), h.alias("h")).orderBy("h", "text").limit(dict_docs)
    with encoder(tokenizer) as own:
        sample = [x + struct.pack("<I", end_id) for x in own.encode([r[0] for r in few.collect()])]
    return shared_dictionary(sample, size)


def shared_dictionary(sample: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the last ``size`` bytes of the sample."""
    try:
        return zstandard.train_dictionary(min(size, max(1 << 10, sum(map(len, sample)) // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-size:]


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_block(docs: list[tuple[int | None, bytes]], before: int, dictionary: bytes, pack: zstandard.ZstdCompressor | None = None) -> bytes:
    """A block of (doc_id, ids as u32 bytes) documents; ``before``: ids before it in its range."""
    pack = pack or zstandard.ZstdCompressor(level=3, dict_data=_dict(dictionary))
    frames = [pack.compress(ids) for _, ids in docs]
    index = np.zeros(len(docs), INDEX)
    index["doc_id"], index["null"] = [x or 0 for x, _ in docs], [x is None for x, _ in docs]
    index["n"] = [len(ids) // 4 for _, ids in docs]
    index["first"] = np.concatenate([[0], np.cumsum(index["n"], dtype=np.uint64)[:-1]]) if docs else []
    index["offset"] = np.concatenate([[0], np.cumsum([len(f) for f in frames], dtype=np.uint64)[:-1]]) if docs else []
    return HEAD.pack(MAGIC, VERSION, sha256(dictionary).digest(), len(docs), before) + index.tobytes() + b"".join(frames)


class Block:
    """A block opened for reading; no frame is decoded until it is asked for."""

    def __init__(self, data: bytes, dictionary: bytes, unpack: zstandard.ZstdDecompressor | None = None):
        magic, version, digest, n, self.before = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of token ids")
        if digest != sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.index = np.frombuffer(data, INDEX, n, HEAD.size)
        self.body = memoryview(data)[HEAD.size + n * INDEX.itemsize :]
        self.unpack = unpack or zstandard.ZstdDecompressor(dict_data=_dict(dictionary))

    def ids(self, k: int) -> bytes:
        """The ids of the block's k-th document."""
        a = int(self.index["offset"][k])
        b = int(self.index["offset"][k + 1]) if k + 1 < len(self.index) else len(self.body)
        return self.unpack.decompress(self.body[a:b])

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document, by its id."""
        hit = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["null"] == 0))
        return np.frombuffer(self.ids(int(hit[0])), np.uint32) if len(hit) else None


BLOCKS = "range_no bigint, block_no bigint, first_doc bigint, last_doc bigint, n_docs bigint, n_ids bigint, block binary"


def write_ids(docs: DataFrame, tokenizer: str, dictionary: bytes, end_id: int, ranges: int, docs_per_block: int = 2048, block_bytes: int = 8 << 20) -> DataFrame:
    """Encode, compress and write; the table of blocks, read back from the shared folder."""
    spark = prepare(docs.sparkSession, 2048, 8 << 20)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer) as own:
            yield from blocks_of(own, batches)

    def blocks_of(own: ByteEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, dict_data=_dict(shared.value))
        part, no, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size, end = 0, struct.pack("<I", end_id)

        def out() -> pa.RecordBatch:
            n = sum(len(x) // 4 for _, x in held)
            row = [part, no, held[0][0], held[-1][0], len(held), n, write_block(held, before, shared.value, pack)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 6 + [pa.binary()], strict=True)], names=["range_no", "block_no", "first_doc", "last_doc", "n_docs", "n_ids", "block"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                held.append((doc, ids + end))
                size += len(ids) + 4
                if len(held) >= docs_per_block or size >= block_bytes:
                    yield out()
                    before += size // 4
                    no, held, size = no + 1, [], 0
        if held:
            yield out()

    # An exchange by number is never coalesced: the partition's number is the range's place in the order.
    dealt = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(dealt.mapInArrow(run, BLOCKS), "blocks")


def read_ids(blocks: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the blocks."""
    spark = prepare(blocks.sparkSession, 64)
    sizes = sorted((r[0], r[1]) for r in blocks.groupBy("range_no").agg(F.sum("n_ids")).collect())  # a row for each range
    base, at = {}, 0
    for k, n in sizes:
        base[k], at = at, at + n
    shared = spark.sparkContext.broadcast((dictionary, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bases = shared.value
        unpack = zstandard.ZstdDecompressor(dict_data=_dict(own))
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block(data, own, unpack)
                ids = [block.ids(k) for k in range(len(block.index))]
                start = block.index["first"].astype(np.int64) + block.before + bases[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.index["doc_id"].astype(np.int64), mask=block.index["null"] == 1),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("range_no", "block").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write every document and read it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return read_ids(write_ids(docs, tokenizer, dictionary, end_id, ranges), dictionary)
