"""Files of a workspace: which are documents, safe names, hashes, uploads, and adapters for binary formats."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of documents.
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".gif")
TEXTS = (".txt", ".md")
DOCX = (".docx",)
SUPPORTED = (".pdf", *IMAGES, *TEXTS, *DOCX)
MAX_UPLOAD = 100 * 1024 * 1024


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]+$", "")


def kind(name: Column) -> Column:
    """pdf, image, text or docx; null for what isn't supported."""
    s = suffix(name)
    return F.when(s == ".pdf", "pdf").when(s.isin(*IMAGES), "image").when(s.isin(*TEXTS), "text").when(s.isin(*DOCX), "docx")


def slug(name: Column) -> Column:
    out = F.lower(F.regexp_replace(F.regexp_replace(stem(name), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(out == "", "doc").otherwise(out)


def safe_name(name: Column) -> Column:
    """The last part of a path with a harmless stem and its suffix in lower case."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    safe = F.regexp_replace(stem(base), "[^a-zA-Z0-9._-]", "_")
    return F.concat(F.when(safe == "", "document").otherwise(safe), suffix(base))


def unique_names(files: DataFrame, column: str = "name", order: str = "ord") -> DataFrame:
    """unique_name: a name that comes again gets -2, -3, ... before its suffix, in order."""
    nth = F.row_number().over(Window.partitionBy(column).orderBy(order))
    numbered = F.concat(stem(F.col(column)), F.lit("-"), nth.cast("string"), F.regexp_extract(column, r"(\.[^./]+)$", 1))
    return files.withColumn("unique_name", F.when(nth == 1, F.col(column)).otherwise(numbered))


def workspace(files: DataFrame, column: str = "name") -> DataFrame:
    """The documents of a folder: supported files that are neither a redacted result nor the PDF made from another
    document of the same stem."""
    name = F.col(column)
    known = files.filter(suffix(name).isin(*SUPPORTED) & ~F.lower(name).endswith(".redacted.pdf"))
    sources = known.filter(suffix(name) != ".pdf").select(F.concat(stem(name), F.lit(".pdf")).alias("twin_")).distinct()
    return known.join(sources, known[column] == sources["twin_"], "left_anti")


def upload_error(name: Column, content: Column) -> Column:
    """Why an upload is refused; null if it is not."""
    pdf_head = F.substring(content, 1, 4) != F.lit(b"%PDF")
    return (
        F.when(kind(name).isNull(), "unsupported file type")
        .when(F.octet_length(content) == 0, "empty file")
        .when(F.octet_length(content) > MAX_UPLOAD, "file too large")
        .when((suffix(name) == ".pdf") & pdf_head, "not a PDF")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content, source_sha256 of the files under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", F.sha2("content", 256).alias("source_sha256"))


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows (cells joined by " | "), a line each."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{space}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    lines = [words(p) for p in body.findall(f"{space}p")]
    for row in body.iter(f"{space}tr"):
        lines.append(" | ".join(words(c) for c in row.findall(f"{space}tc")))
    return "\n".join(lines)


Adapter = Callable[[str, bytes], str]
_ADAPTERS: dict[str, Adapter] = {"text": lambda name, data: data.decode("utf-8", "replace"), "docx": lambda name, data: docx_text(data)}


def register_adapter(file_kind: str, adapter: Adapter) -> None:
    """A function (name, bytes) -> text for a kind of file ("pdf", "image"): a parser or an OCR engine."""
    _ADAPTERS[file_kind] = adapter


def extract_text(files: DataFrame) -> DataFrame:
    """name, text, error: texts by the adapter of each file's kind; a failing or missing adapter gives an error, not a stop."""
    adapters = dict(_ADAPTERS)

    def one(file_kind: str | None, name: str, data: bytes) -> tuple[str | None, str | None]:
        if file_kind not in adapters:
            return None, f"no adapter for {file_kind or 'this kind of file'}"
        try:
            return adapters[file_kind](name, data), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(k, n, bytes(c)) for k, n, c in zip(b["kind"], b["name"], b["content"], strict=True)]
            yield pd.DataFrame({"name": b["name"], "text": [g[0] for g in got], "error": [g[1] for g in got]})

    return files.select("name", "content", kind(F.col("name")).alias("kind")).mapInPandas(run, "name string, text string, error string")


def engine_chain(requested: str | None, available: dict[str, Callable[[], bool]], order: tuple[str, ...] = ("rapidocr", "tesseract", "paddleocr")) -> list[str]:
    """OCR engines to try: the one asked for alone, else those available, in order of preference."""
    if requested:
        if requested not in available:
            raise ValueError(f"no OCR engine {requested!r}; there are {', '.join(available)}")
        return [requested]
    return [n for n in (*order, *(x for x in available if x not in order)) if n in available and available[n]()]


def first_that_works(engines: list[tuple[str, Adapter]], name: str, data: bytes) -> str:
    """The text of the first engine that does not fail; all errors together where all fail."""
    errors = []
    for engine, adapter in engines:
        try:
            return adapter(name, data)
        except Exception as e:  # noqa: BLE001
            errors.append(f"{engine}: {e}")
    raise RuntimeError("no OCR engine could read the file: " + "; ".join(errors))


def numbered(name: str, taken: set[str]) -> str:
    """A name that isn't taken, for the driver: name-2.ext, name-3.ext, ..."""
    m = re.fullmatch(r"(.*?)(\.[^.]*)?", name)
    i = 2
    while (new := f"{m[1]}-{i}{m[2] or ''}") in taken:
        i += 1
    return new
