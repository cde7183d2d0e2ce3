"""Parsers and OCR engines as adapters that give pages with boxes: files -> pages -> blocks.

A parser is a function (name, bytes) -> pages, each a dict with page_number, width, height and, where known, rotation,
encrypted, images ([{box, data, mime_type}]) and lines ([{text, box, confidence}]); a box is (x0, y0, x1, y1) in points. Text
and DOCX are parsed here, on the page that ``sources.text`` lays text out on; parsers of PDF and images are registered.
An OCR engine is a function (png) -> [(corners in pixels, text, confidence from 0 to 1)].
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilspark.functions.geometry import box as box_of
from veilspark.functions.geometry import words_with_boxes
from veilspark.schema import BBOX
from veilspark.sources import files
from veilspark.sources import text as t

Parser = Callable[[str, bytes], Iterable[dict]]
Read = Callable[[bytes], Iterable[tuple]]
Raster = Callable[[str, bytes, float], Iterable[tuple[int, float, float, bytes]]]
PAGES = (
    "doc_id bigint, name string, page_number int, width double, height double, rotation int, encrypted boolean, "
    f"images array<struct<bbox:{BBOX},data:binary,mime_type:string>>, lines array<struct<text:string,bbox:{BBOX},confidence:double>>, error string"
)
ENGINE_SETTING = "VEILSPARK_OCR_ENGINE"


class ConversionError(ValueError):
    """A file cannot be read as pages: no parser for its kind, or it is damaged."""


def text_pages(text: str) -> list[dict]:
    """The pages that ``sources.text.wrapped_blocks`` lays a text out on."""
    cut = t.CHARS_PER_LINE, t.LINES_PER_PAGE
    lines = [part for x in text.replace("\t", "    ").splitlines() for part in t.wrap_line(x, cut[0])]
    out = []
    for k in range(0, max(len(lines), 1), cut[1]):
        rows = [{"text": x, "box": (t.MARGIN, t.MARGIN + i * t.LINE, t.MARGIN + len(x) * t.CHAR_WIDTH, t.MARGIN + (i + 1) * t.LINE), "confidence": 1.0} for i, x in enumerate(lines[k : k + cut[1]]) if x]
        out.append({"page_number": k // cut[1] + 1, "width": t.PAGE_WIDTH, "height": t.PAGE_HEIGHT, "lines": rows})
    return out


_PARSERS: dict[str, Parser] = {
    "text": lambda name, data: text_pages(data.decode("utf-8", "replace")),
    "docx": lambda name, data: text_pages(files.docx_text(data)),
}


def register_parser(file_kind: str, parser: Parser) -> None:
    _PARSERS[file_kind] = parser


def _box(b: tuple) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True))


def parse(found: DataFrame) -> DataFrame:
    """PAGES of files (doc_id, name, content) by the parser of each file's kind. A file without a parser, or one its parser
    fails on, is one row with an error and no page, and stops no other."""
    parsers, schema = dict(_PARSERS), StructType.fromDDL(PAGES)
    arrow = to_arrow_schema(schema)
    none = dict.fromkeys(schema.names)

    def pages(kind: str | None, name: str, data: bytes) -> Iterator[dict]:
        if kind not in parsers:
            raise ConversionError(f"no parser for {kind or 'this kind of file'}")
        for p in parsers[kind](name, data):
            images = [{"bbox": _box(i["box"]), "data": i.get("data"), "mime_type": i.get("mime_type")} for i in p.get("images", ())]
            lines = [{"text": x["text"], "bbox": _box(x["box"]), "confidence": float(x.get("confidence", 1.0))} for x in p.get("lines", ())]
            yield none | {"page_number": p["page_number"], "width": float(p["width"]), "height": float(p["height"]), "rotation": p.get("rotation", 0), "encrypted": p.get("encrypted", False), "images": images, "lines": lines}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, name, data, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = list(pages(kind, name, data or b""))
                except Exception as e:  # noqa: BLE001 - one file's fault is its row's
                    rows = [none | {"error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist([r | {"doc_id": doc_id, "name": name} for r in rows], schema=arrow)

    source = found.select(F.col("doc_id").cast("bigint"), "name", "content", files.kind(F.col("name")).alias("kind"))
    return source.mapInArrow(run, schema)


def outdated(sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """The sources (name, modified) that have not been parsed since they last changed; ``parsed`` has name and parsed_at."""
    last = parsed.groupBy(F.col("name").alias("n_")).agg(F.max("parsed_at").alias("at_"))
    return sources.join(last, F.col("name") == F.col("n_"), "left").filter(F.col("at_").isNull() | (F.col("at_") < F.col("modified"))).drop("n_", "at_")


def blocks(pages: DataFrame) -> DataFrame:
    """Text blocks (a line each, with words), then a page's image blocks; block_ord counts through the document. Blank lines and
    boxes without an area are no blocks."""
    area = lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    lines = F.transform(F.filter("lines", lambda x: x["text"].rlike(r"\S") & area(x["bbox"])), lambda x: F.struct(F.lit("text").alias("block_type"), x["text"].alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence"), F.lit(None).cast("string").alias("mime_type"), F.lit(None).cast("bigint").alias("n_bytes")))
    images = F.transform(F.filter("images", lambda x: area(x["bbox"])), lambda x: F.struct(F.lit("image").alias("block_type"), F.lit("").alias("text"), x["bbox"].alias("bbox"), F.lit(1.0).alias("confidence"), x["mime_type"].alias("mime_type"), F.octet_length(x["data"]).cast("bigint").alias("n_bytes")))
    each = pages.filter("error IS NULL").withColumn("all_", F.concat(lines, images))
    start = F.coalesce(F.sum(F.size("all_")).over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = each.select("doc_id", "page_number", start.alias("from_"), "all_").select("doc_id", "page_number", "from_", F.posexplode("all_").alias("nth", "b"))
    words = F.when(F.col("b.block_type") == "text", words_with_boxes(F.col("b.text"), F.col("b.bbox")))
    return rows.select("doc_id", "page_number", (F.col("from_") + F.col("nth")).cast("int").alias("block_ord"), "b.*", words.alias("words"))


def listing(found: DataFrame) -> DataFrame:
    """What a scan shows of each block: a text's beginning, an image's size in bytes."""
    shown = F.when(F.col("block_type") == "image", F.concat(F.coalesce("n_bytes", F.lit(0)).cast("string"), F.lit(" bytes"))).otherwise(t.preview(F.col("text")))
    return found.select("doc_id", "page_number", "block_ord", "block_type", "bbox", shown.alias("preview"))


# --- OCR ---


def ocr_line(corners: Iterable[tuple[float, float]], text: str | None, confidence: float, dpi: float, width: float, height: float) -> dict | None:
    """A line of a page from corners in pixels: the upright box around them in points, within the page, and the confidence
    within 0 to 1. Blank texts, and what lies off the page, give none."""
    xs, ys = zip(*corners, strict=True)
    scale = dpi / 72.0
    b = max(min(xs) / scale, 0.0), max(min(ys) / scale, 0.0), min(max(xs) / scale, width), min(max(ys) / scale, height)
    if not (text or "").strip() or b[2] <= b[0] or b[3] <= b[1]:
        return None
    return {"text": text, "box": b, "confidence": max(0.0, min(1.0, float(confidence)))}


def ocr_parser(raster: Raster, read: Read, dpi: float = 200.0) -> Parser:
    """A parser that reads pictures of pages: ``raster`` gives (page_number, width, height, png) at a resolution."""

    def run(name: str, data: bytes) -> Iterator[dict]:
        for number, width, height, png in raster(name, data, dpi):
            lines = (ocr_line(corners, text, confidence, dpi, width, height) for corners, text, confidence in read(png))
            yield {"page_number": number, "width": width, "height": height, "lines": [x for x in lines if x]}

    return run


def _rapid(languages: str) -> Read:
    from rapidocr_onnxruntime import RapidOCR

    engine = RapidOCR()
    return lambda png: engine(png)[0] or ()


def _paddle(languages: str) -> Read:
    import io

    import numpy as np
    from paddleocr import PaddleOCR
    from PIL import Image

    engine = PaddleOCR(use_angle_cls=True, lang=languages or "en")

    def read(png: bytes) -> Iterator[tuple]:
        for page in engine.ocr(np.asarray(Image.open(io.BytesIO(png)).convert("RGB"))) or ():
            for corners, (text, confidence) in page or ():
                yield corners, text, confidence

    return read


def _tesseract(languages: str) -> Read:
    import io

    from PIL import Image
    from tesserocr import RIL, PyTessBaseAPI, iterate_level

    api = PyTessBaseAPI(lang=languages or "eng")

    def read(png: bytes) -> Iterator[tuple]:
        api.SetImage(Image.open(io.BytesIO(png)))
        api.Recognize()
        for line in iterate_level(api.GetIterator(), RIL.TEXTLINE):
            got = line.BoundingBox(RIL.TEXTLINE)
            if got:
                x0, y0, x1, y1 = got
                yield [(x0, y0), (x1, y1)], (line.GetUTF8Text(RIL.TEXTLINE) or "").strip(), line.Confidence(RIL.TEXTLINE) / 100.0

    return read


@dataclass(frozen=True)
class Engine:
    """``needs``: modules it can't do without; ``start``: languages -> the function that reads a picture, on the worker."""

    name: str
    needs: tuple[str, ...]
    start: Callable[[str], Read]

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("an OCR engine needs a name")

    def available(self) -> bool:
        return all(importlib.util.find_spec(x) is not None for x in self.needs)


#: In order of preference.
ENGINES: dict[str, Engine] = {e.name: e for e in (Engine("rapidocr", ("rapidocr_onnxruntime",), _rapid), Engine("tesseract", ("tesserocr", "PIL"), _tesseract), Engine("paddleocr", ("paddleocr", "PIL"), _paddle))}


def register_engine(engine: Engine) -> None:
    ENGINES[engine.name] = engine


def engines(requested: str | None = None) -> list[Engine]:
    """The engines to try: the one asked for (here or by the setting VEILSPARK_OCR_ENGINE) alone, else all available."""
    wanted = requested or os.environ.get(ENGINE_SETTING) or None
    return [ENGINES[n] for n in files.engine_chain(wanted, {n: e.available for n, e in ENGINES.items()}, tuple(ENGINES))]


def reader(chosen: list[Engine], languages: str = "") -> Read:
    """Reads with the first engine that starts and doesn't fail on the picture; all errors together where all fail."""
    started: dict[str, Read] = {}

    def read(png: bytes) -> list[tuple]:
        errors = []
        for e in chosen:
            try:
                if e.name not in started:
                    started[e.name] = e.start(languages)
                return list(started[e.name](png))
            except Exception as x:  # noqa: BLE001 - the next engine may do
                errors.append(f"{e.name}: {x}")
        raise RuntimeError("no OCR engine could read the page: " + "; ".join(errors or ["none is available"]))

    return read


def clamped(pages: DataFrame) -> DataFrame:
    """Pages whose lines' boxes lie within the page."""
    w, h = F.col("width"), F.col("height")
    inside = lambda b: box_of(F.greatest(b["x0"], F.lit(0.0)), F.greatest(b["y0"], F.lit(0.0)), F.least(b["x1"], w), F.least(b["y1"], h))
    return pages.withColumn("lines", F.transform("lines", lambda x: F.struct(x["text"].alias("text"), inside(x["bbox"]).alias("bbox"), x["confidence"].alias("confidence"))))
