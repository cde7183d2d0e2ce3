"""What a renderer has to draw: the lines that a redaction touches, what is left of them, and the marks in their place.

A renderer rewrites a line as a whole, so a line that a redaction touches goes with all its text, and so does every line whose
box meets a line that goes; what is left of them is written again at its own place. The drawing is a table; an adapter
(name, bytes, operations) -> bytes carries it out.

Order of drawing: ``remove`` (a line's text), ``clear`` (pixels of pictures in a redaction), ``fill`` (its background, or
black for a bar), ``text`` (the replacement), ``text`` (what is left), ``highlight`` (drawn over the text).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.redaction import BLACK_BAR, HIGHLIGHT
from veilspark.schema import BBOX

# Size of replacements where the page gives none, smallest size, share of a box's height that a size may take,
# width of an asterisk in Helvetica, points that a character may lie off the end of the one before in one piece of text,
# replacement where a redaction has none, opacity of highlights.
SIZE, SMALLEST, OF_HEIGHT, STAR, APART, REPLACEMENT, OPACITY = 11.0, 4.0, 0.75, 0.389, 0.3, "*****", 0.3
BLACK, WHITE, YELLOW = 0x000000, 0xFFFFFF, 0xFFFF00
CHAR = f"struct<char:string,bbox:{BBOX},x:double,y:double,font:string,size:double,color:int>"
LINES = f"array<struct<line_ord:int,bbox:{BBOX}>>"
OPERATIONS = f"step int, op string, bbox {BBOX}, text string, x double, y double, font string, size double, color int"


def base14(font: Column) -> Column:
    """The standard font of the family: fixed width, serif, or sans."""
    name = F.lower(F.coalesce(font, F.lit("")))
    return F.when(name.rlike("courier|mono"), "cour").when(name.rlike("times|georgia|garamond|book"), "tiro").otherwise("helv")


def fallback_size(height: Column) -> Column:
    return F.greatest(F.lit(SMALLEST), F.least(F.lit(SIZE), height * OF_HEIGHT))


def fitted(replacement: Column, width: Column, size: Column) -> Column:
    """Stars cut to the width, one at least; other texts as they are."""
    room = F.greatest(F.lit(1), F.floor(width / (size * STAR)).cast("int"))
    return F.when(replacement.rlike(r"^\*+$") & (size > 0), F.substring(replacement, F.lit(1), room)).otherwise(replacement)


def border_color(pixels: np.ndarray) -> int:
    """The commonest color on the rim of a picture (height x width x 3), as 0xRRGGBB; white where it is too small."""
    if pixels.shape[0] < 3 or pixels.shape[1] < 3:
        return WHITE
    rim = np.concatenate([pixels[0], pixels[-1], pixels[:, 0], pixels[:, -1]])[:, :3].astype(int)
    return Counter((rim @ np.array([65536, 256, 1])).tolist()).most_common(1)[0][0]


def _touched(lines: pd.Series, boxes: pd.Series) -> pd.Series:
    def meet(b: np.ndarray, many: np.ndarray) -> np.ndarray:
        return (np.minimum(b[2], many[:, 2]) > np.maximum(b[0], many[:, 0])) & (np.minimum(b[3], many[:, 3]) > np.maximum(b[1], many[:, 1]))

    def page(xs: Sequence[dict], rs: Sequence[dict]) -> list[int]:
        at = np.array([[x["bbox"][k] for k in ("x0", "y0", "x1", "y1")] for x in xs]).reshape(-1, 4)
        gone = np.zeros(len(at), bool)
        waiting = [np.array([r[k] for k in ("x0", "y0", "x1", "y1")]) for r in rs]
        while waiting:
            new = meet(waiting.pop(), at) & ~gone
            gone |= new
            waiting += list(at[new])
        return [xs[i]["line_ord"] for i in np.flatnonzero(gone)]

    return pd.Series([page(a, b) for a, b in zip(lines, boxes, strict=True)])


def touched(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """doc_id, page_number, line_ord of the lines that go. Only pages with a redaction are looked at, a page at a time."""
    key = ["doc_id", "page_number"]
    boxes = jobs.groupBy(*key).agg(F.collect_list("bbox").alias("boxes"))
    page = lines.join(boxes.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct("line_ord", "bbox")).cast(LINES).alias("lines"))
    found = F.pandas_udf(_touched, "array<int>")("lines", "boxes")
    return page.join(boxes, key).select(*key, F.explode(found).alias("line_ord"))


def pieces(chars: Column) -> Column:
    """Runs of characters (CHAR) that follow each other in one style, as array<struct<text, x, y, font, size, color>>."""
    piece = "struct<text:string,x:double,y:double,font:string,size:double,color:int,end:double>"
    new = lambda c: F.struct(c["char"].alias("text"), c["x"].alias("x"), c["y"].alias("y"), c["font"].alias("font"), c["size"].alias("size"), c["color"].alias("color"), c["bbox"]["x1"].alias("end"))

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce((F.abs(c["x"] - last["end"]) <= APART) & (c["y"] == last["y"]) & c["font"].eqNullSafe(last["font"]) & c["size"].eqNullSafe(last["size"]) & c["color"].eqNullSafe(last["color"]), F.lit(False))
        longer = F.struct(F.concat(last["text"], c["char"]).alias("text"), *(last[k].alias(k) for k in ("x", "y", "font", "size", "color")), c["bbox"]["x1"].alias("end"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(new(c))))

    return F.aggregate(chars, F.array().cast(f"array<{piece}>"), step)


def drawing(lines: DataFrame, jobs: DataFrame, backgrounds: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number and OPERATIONS.

    ``lines``: doc_id, page_number, line_ord, bbox, chars (array of CHAR); ``jobs``: doc_id, page_number, redaction_type,
    replacement_text, bbox; ``backgrounds``: doc_id, page_number, bbox, color, sampled before anything is drawn. A
    replacement takes the place and style of the first character whose middle it covers; without one (a picture)
    Helvetica in a size that suits the box."""
    key = ["doc_id", "page_number"]
    bright, jobs = jobs.filter(F.col("redaction_type") == HIGHLIGHT), jobs.filter(F.col("redaction_type") != HIGHLIGHT)
    gone = lines.join(touched(lines, jobs), [*key, "line_ord"])
    page = jobs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0"), "bbox", "redaction_type", "replacement_text"))).alias("jobs"))
    within = lambda c, j, a, z: ((c["bbox"][a] + c["bbox"][z]) / 2).between(j["bbox"][a], j["bbox"][z])
    covers = lambda c, j: within(c, j, "x0", "x1") & within(c, j, "y0", "y1")
    hit = gone.join(page, key)
    left = hit.select(*key, "line_ord", F.explode(pieces(F.filter("chars", lambda c: ~F.exists("jobs", lambda j: covers(c, j))))).alias("p")).select(*key, "p.*").filter(F.col("text").rlike(r"\S"))
    first = F.transform("jobs", lambda j: F.struct(j["bbox"].alias("bbox"), F.get(F.filter("chars", lambda c: covers(c, j)), F.lit(0)).alias("c")))
    anchors = hit.select(*key, "line_ord", F.explode(first).alias("a")).filter("a.c IS NOT NULL").groupBy(*key, "a.bbox").agg(F.min_by("a.c", "line_ord").alias("c"))
    j = jobs.join(anchors, [*key, "bbox"], "left")
    if backgrounds is not None:
        j = j.join(backgrounds.select(*key, "bbox", F.col("color").alias("under")).dropDuplicates([*key, "bbox"]), [*key, "bbox"], "left")
    else:
        j = j.withColumn("under", F.lit(None).cast("int"))
    height = F.col("bbox.y1") - F.col("bbox.y0")
    size = F.coalesce(F.col("c.size"), fallback_size(height))
    base = F.coalesce(F.col("c.y"), F.col("bbox.y1") - height * 0.25)
    none = F.lit(None)
    op = lambda step, name, bbox=none, text=none, x=none, y=none, font=none, size=none, color=none: [F.lit(step).alias("step"), F.lit(name).alias("op"), bbox.cast(BBOX).alias("bbox"), text.cast("string").alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), font.cast("string").alias("font"), size.cast("double").alias("size"), color.cast("int").alias("color")]
    fill = F.when(F.col("redaction_type") == BLACK_BAR, F.lit(BLACK)).otherwise(F.coalesce("under", F.lit(WHITE)))
    marks = j.filter(F.col("redaction_type") != BLACK_BAR)
    parts = [
        gone.select(*key, *op(1, "remove", F.col("bbox"))),
        jobs.select(*key, *op(2, "clear", F.col("bbox"))),
        j.select(*key, *op(3, "fill", F.col("bbox"), color=fill)),
        marks.select(*key, *op(4, "text", F.col("bbox"), fitted(F.coalesce("replacement_text", F.lit(REPLACEMENT)), F.col("bbox.x1") - F.col("bbox.x0"), size), F.col("bbox.x0"), base, F.when(F.col("c").isNull(), "helv").otherwise(base14(F.col("c.font"))), size, F.coalesce(F.col("c.color"), F.lit(BLACK)))),
        left.select(*key, *op(5, "text", text=F.col("text"), x=F.col("x"), y=F.col("y"), font=base14(F.col("font")), size=F.col("size"), color=F.col("color"))),
        bright.select(*key, *op(6, "highlight", F.col("bbox"), color=F.lit(YELLOW))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


Renderer = Callable[[str, bytes, list[dict]], bytes]
Plain = Callable[[str, bytes, list[dict]], bytes]


def render(files: DataFrame, operations: DataFrame, renderer: Renderer, plain: Plain | None = None) -> DataFrame:
    """doc_id, name, content, error: each file (doc_id, name, content) as the renderer makes it from its operations, in order.
    Where that fails, ``plain`` is given the redactions alone (clear, fill and their texts), without what is left of lines. A
    file without operations stays as it is; one that can't be redacted has an error and no content, never its own."""
    order = F.struct("page_number", "step", F.coalesce("bbox.y0", "y").alias("top"), F.coalesce("bbox.x0", "x").alias("left"), "op", "bbox", "text", "x", "y", "font", "size", "color")
    mine = operations.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("ops"))
    rows = files.select("doc_id", "name", "content").join(mine, "doc_id", "left")

    def one(name: str, data: bytes, ops: list[dict] | None) -> tuple[bytes | None, str | None]:
        if ops is None:
            return data, None
        errors = []
        for draw, given in ((renderer, ops), (plain, [o for o in ops if o["step"] in (2, 3, 4, 6)])):
            if draw is None:
                continue
            try:
                return draw(name, data, given), None
            except Exception as e:  # noqa: BLE001 - one file's fault is its row's
                errors.append(f"{type(e).__name__}: {e}")
        return None, "; ".join(errors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(n, bytes(c), None if o is None else [dict(x) for x in o]) for n, c, o in zip(b["name"], b["content"], b["ops"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "name": b["name"], "content": [g[0] for g in got], "error": [g[1] for g in got]})

    return rows.mapInPandas(run, "doc_id bigint, name string, content binary, error string")


def page_images(files: DataFrame, raster: Callable, dpi: float = 144.0) -> DataFrame:
    """doc_id, page_number, width, height, scale, png of every page; ``raster`` as for OCR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, name, data in zip(b["doc_id"], b["name"], b["content"], strict=True):
                rows = [(doc_id, n, w, h, dpi / 72.0, png) for n, w, h, png in raster(name, bytes(data), dpi)]
                yield pd.DataFrame(rows, columns=["doc_id", "page_number", "width", "height", "scale", "png"])

    return files.select("doc_id", "name", "content").mapInPandas(run, "doc_id bigint, page_number int, width double, height double, scale double, png binary")
