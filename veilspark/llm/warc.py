"""WARC 1.1 archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: each task writes one gzip archive, a member per record, under a name of its own; committing adds a list of the
names of the tasks that count, so that files of failed or repeated tasks are never read. Appending adds a list,
overwriting replaces all lists and deletes the archives of the old ones. Reading: a partition per group of archive files
(``split_bytes``); filters on ``record_type`` and on headers (``page_id``, ``refers_to``, ``target_uri``,
``payload_digest``, ``payload_bytes``) are pushed down; the headers of a record are parsed first, and the rest of a record
that no filter lets through, or whose payload isn't selected (option ``payload=false``), is not decoded: the compressed
length stands in the member's own gzip extra field ("sl"), so the reader moves straight to the next one.

Archives of others are read too: a folder without such lists is searched for ``.warc`` and ``.warc.gz`` files, and a path
may be one file. Plain archives are moved through by Content-Length; compressed ones have to be inflated to find the next
record, but what isn't wanted is thrown away at once. A damaged member (check sum or length) is an error.

Records with equal payloads of at least ``min_bytes`` bytes: the one with the smallest page_id is the response, the others
are revisits that refer to it. Both carry the digest and the length of the full payload. The block of a response is an HTTP
response with the payload, that of a revisit its head alone. Record ids are UUIDs made from page_id and digest, so a task
that runs again writes the same records; equal rows share an id. WARC-Date is the time of writing (option ``date``).

Edge cases: a null html is an empty payload; an empty table gives no records; rows that repeat the smallest page_id of
equal payloads are responses, each with its payload; null page_ids and urls stay null (their headers are left out); other
columns of the input are ignored. Read from others: page_id and refers_to are null, the payload is what stands after the
HTTP head (transfer and content codings stay), or the whole block where it is not HTTP; a revisit has none.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row

from veilspark.llm.common import cut, prepare, scratch

SCHEMA = "page_id bigint, target_uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
COLUMNS = ("page_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
_START = struct.Struct("<4BIBBH2sHII")  # magic, method, flags; time; xfl; os; extra: "sl", bytes of the headers and of the block
_LIST = "_archives-"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs
FEW = 200_000  # repeated digests that are broadcast; more are joined by shuffling


def _store(path: str):  # noqa: ANN202
    """The file system of a URI, and the path in it: local, HDFS or an object store, as Arrow reads them."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """file:/x, as Spark writes it, to file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _line(x: object) -> str:
    return str(x).replace("\r", " ").replace("\n", " ")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def pack(row: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record as one gzip member: its headers and its block are deflate streams of their own, so either can be read alone."""
    revisit, digest = row["record_type"] == "revisit", row["payload_digest"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    if not revisit:
        block += row["payload"] or b""
    lines = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", record_id(row["page_id"], digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("WARC-Refers-To", None if row["refers_to"] is None else record_id(row["refers_to"], digest)),
        ("X-Page-ID", row["page_id"]),
        ("X-Refers-To-Page", row["refers_to"]),
        ("X-Payload-Length", row["payload_bytes"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = ("WARC/1.1\r\n" + "".join(f"{k}: {_line(x)}\r\n" for k, x in lines if x is not None) + "\r\n").encode()
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    first = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH)  # the headers end at a byte and a reset of the window
    rest = z.compress(block + b"\r\n\r\n") + z.flush()
    whole = head + block + b"\r\n\r\n"
    start = _START.pack(31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, len(first), len(rest))
    return start + first + rest + struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)


def headers(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case; a line that begins with a blank continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        x = line.decode("utf-8", "replace").rstrip("\r\n")
        if x[:1] in (" ", "\t") and name:
            out[name] += " " + x.strip()
        elif ":" in x:
            name, _, value = x.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def fields(h: dict[str, str]) -> dict:
    digest = h.get("warc-payload-digest")
    uri = h.get("warc-target-uri")
    return {
        "page_id": _number(h.get("x-page-id")),
        "target_uri": uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri,
        "record_type": h.get("warc-type"),
        "payload_bytes": _number(h.get("x-payload-length")),
        "payload_digest": digest.removeprefix("sha256:") if digest else digest,
        "refers_to": _number(h.get("x-refers-to-page")),
    }


def holds(f: Filter, row: dict) -> bool:
    x = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, IsNotNull):
        return x is not None
    if x is None:
        return False
    if isinstance(f, In):
        return x in f.value
    return {EqualTo: x == f.value, GreaterThan: x > f.value, GreaterThanOrEqual: x >= f.value, LessThan: x < f.value, LessThanOrEqual: x <= f.value}[type(f)] if type(x) is type(f.value) or not isinstance(x, str) else False


def records(stream: io.IOBase, filters: Sequence[Filter] = (), payload: bool = True) -> Iterator[tuple]:
    """Rows of an archive. Headers first; the payload of a row that isn't wanted is skipped, not decoded."""
    while True:
        at = stream.tell()
        start = stream.read(_START.size)
        if len(start) < _START.size or start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl":
            break
        n_head, n_body = _START.unpack(start)[-2:]
        head = zlib.decompressobj(-15).decompress(stream.read(n_head))
        row = fields(headers(head.split(b"\r\n")[1:]))
        if not all(holds(f, row) for f in filters):
            stream.seek(n_body + 8, 1)
            continue
        body = None
        if payload and row["record_type"] == "response":
            block = zlib.decompressobj(-15).decompress(stream.read(n_body))
            if stream.read(8) != struct.pack("<II", zlib.crc32(block, zlib.crc32(head)), len(head) + len(block) & 0xFFFFFFFF):
                raise ValueError(f"damaged record at byte {at}")
            body = block[block.index(b"\r\n\r\n") + 4 : -4]
        else:
            stream.seek(n_body + 8, 1)
        yield (*(row[c] for c in COLUMNS[:-1]), body)
    if start:
        stream.seek(at)
        packed = start[:2] == b"\x1f\x8b"
        yield from foreign(gzip.GzipFile(fileobj=stream) if packed else io.BufferedReader(stream), packed, filters, payload)


def foreign(stream: io.BufferedIOBase, packed: bool, filters: Sequence[Filter], payload: bool) -> Iterator[tuple]:
    """Rows of an archive that this source did not write."""

    def skip(n: int) -> None:
        if not packed:
            stream.seek(n, 1)
        while packed and n > 0:
            n -= len(stream.read(min(n, 1 << 20))) or n

    def head() -> list[bytes]:
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        return [*lines, line]

    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        h = headers(head())
        if "content-length" not in h:
            raise ValueError("a WARC record without Content-Length")
        left, row = int(h["content-length"]), fields(h)
        later = [f for f in filters if row[f.attribute[0]] is None and f.attribute[0] == "payload_bytes"]
        body, full = None, row["record_type"] != "revisit"
        if all(holds(f, row) for f in filters if f not in later):
            if full and h.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
                left -= sum(map(len, head()))
            if full and row["payload_bytes"] is None:
                row["payload_bytes"] = left
            if all(holds(f, row) for f in later):
                if full and payload:
                    body = stream.read(left)
                    if len(body) < left:
                        raise ValueError("an archive ends inside a record")
                    left = 0
                yield (*(row[c] for c in COLUMNS[:-1]), body)
        skip(left)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = _uri(options["path"]), str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", 32 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: ANN201, N802
        for f in filters:
            known = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNull, IsNotNull))
            if known and len(f.attribute) == 1 and f.attribute[0] in COLUMNS[:-1]:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for name, n in archives(self.path):
            held.append(name)
            size += n
            if size >= self.split:
                out.append(Files(held))
                held, size = [], 0
        return [*out, *([Files(held)] if held else [])] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _store(self.path)
        for name in partition.files:
            with fs.open_input_file(name) as f:
                yield from records(f, self.filters, self.payload)


def archives(uri: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives that count: those in the folder's lists, else all files with a WARC's suffix, else the
    file itself."""
    import pyarrow.fs as pafs

    fs, path = _store(uri)
    if (info := fs.get_file_info(path)).type == pafs.FileType.File:
        return [(path, info.size)]
    files = sorted((f for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file), key=lambda f: f.path)
    lists = [f.path for f in files if f.base_name.startswith(_LIST)]
    if not lists:
        return [(f.path, f.size) for f in files if f.base_name.lower().endswith((".warc", ".warc.gz"))]
    out = []
    for x in lists:
        with fs.open_input_stream(x) as f:
            out += [(f"{path}/{name}", int(n)) for name, n in (line.split("\t") for line in f.read().decode().splitlines())]
    return out


class Written(WriterCommitMessage):
    def __init__(self, name: str | None, size: int):
        self.name, self.size = name, size


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = _uri(options["path"]), overwrite
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        fs, path = _store(self.path)
        name, size, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for row in rows:
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)
            data = pack(row.asDict(), self.date)
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(name if out is not None else None, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        import pyarrow.fs as pafs

        fs, path = _store(self.path)
        fs.create_dir(path, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith(_LIST)] if self.overwrite else []
        gone = [x for x, _ in archives(self.path)] if old else []
        with fs.open_output_stream(f"{path}/{_LIST}{uuid.uuid4().hex}") as f:
            f.write("".join(f"{m.name}\t{m.size}\n" for m in messages if m and m.name).encode())
        for x in [*old, *gone]:  # lists first: a reader sees no archive that is gone
            fs.delete_file(x)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _store(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def to_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Rows for the writer. Only digests are grouped to find the first page of equal payloads. Up to FEW repeated digests are
    broadcast, so that no payload is shuffled; beyond that the rows meet them by digest, short payloads dealt by page."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("target_uri"), html.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    copies = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.col("payload_digest").alias("repeated"), "first_page")
    copies = cut(copies, "repeats")
    if copies.count() <= FEW:
        copies = F.broadcast(copies)
    key = F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string")))
    joined = rows.join(copies, key == F.col("repeated"), "left").drop("repeated")
    return joined.withColumn("revisit", F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")))


def archive(pages: DataFrame, path: str, min_bytes: int = 100, mode: str = "append") -> None:
    """Write the archives of the pages to ``path``; equal payloads are found within the pages, not in earlier archives."""
    register(prepare(pages.sparkSession))
    rows = to_records(pages, min_bytes)
    revisit = F.col("revisit")
    out = rows.select("page_id", "target_uri", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "payload_bytes", "payload_digest", F.when(revisit, F.col("first_page")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))
    out.write.format("warc").mode(mode).save(path)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = register(pages.sparkSession)
    path = path or f"{scratch(spark)}/warc"
    archive(pages, path)
    got = spark.read.format("warc").load(path)
    # Responses are checked against what was read; a revisit's headers speak for the payload it refers to.
    read_bytes, read_digest = F.octet_length("payload").cast("bigint"), F.sha2("payload", 256)
    response = F.col("record_type") == "response"
    return got.select("page_id", F.when(response, read_bytes).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(response, read_digest).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to FROM q
"""
