"""A review of documents from detection to redacted text.

The steps of a reviewer are kept as a list and laid over the entries that the run found, so that any of them can be undone and
nothing is held on the driver but the steps themselves. The run's entries are written once to ``spark.checkpoint.dir`` where
it is set; every later question starts there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.geometry import words_with_boxes
from veilspark.operators import context, decision, fusion, hybrid, quality, redaction, rendering, session
from veilspark.operators.registry import Registry, default_registry, with_ids
from veilspark.sources import plans

Ocr = Callable[[DataFrame], DataFrame]  # doc_id of documents -> their OCR blocks
BY_PAGE = ("manual", "remembered")  # detectors whose offsets count from the page's beginning


def chosen_text(native: DataFrame, ocr: Ocr | None, auto: bool = True, force_ocr: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """Blocks with ``source``: each document's native text, its OCR, or both merged, as its diagnostics say (``auto``) or as
    forced. Only documents that need it reach the OCR; without one, everything is native."""
    if ocr is None or not (auto or force_ocr):
        return native.withColumn("source", F.lit("native"))
    d = quality.diagnose(native, pages=pages)
    way = d.select("doc_id", quality.route(F.col("recommendation"), auto, force_ocr, F.col("has_native_text")).alias("source"))
    pick = lambda s: way.filter(F.col("source") == s).select("doc_id")
    of = lambda rows, s: rows.join(pick(s), "doc_id", "left_semi")
    columns = native.columns
    read = ocr(way.filter("source <> 'native'").select("doc_id")).select(*columns)
    both = hybrid.merge(of(native, "hybrid"), of(read, "hybrid")).drop("provenance")
    named = lambda rows, s: rows.select(*columns, F.lit(s).alias("source"))
    # Merged pages are numbered by place and both sides begin at any block number: blocks are numbered anew by page.
    order = Window.partitionBy("doc_id", "page_number").orderBy("bbox.y0", "bbox.x0", "block_ord", "text")
    first = F.coalesce(F.col("before_"), F.lit(0))
    numbered = both.withColumn("nth_", F.row_number().over(order))
    sizes = numbered.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n_"))
    starts = sizes.withColumn("before_", F.sum("n_").over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))).drop("n_")
    both = numbered.join(starts, ["doc_id", "page_number"]).withColumn("block_ord", (first + F.col("nth_") - 1).cast("int"))
    return named(of(native, "native"), "native").unionByName(named(both, "hybrid")).unionByName(named(of(read, "ocr"), "ocr"))


def in_blocks(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The entries with offsets within their blocks: marks and remembered terms count from the page's beginning."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
    text = blocks.filter(F.col("block_type") == "text")
    start = text.select("doc_id", "page_number", "block_ord", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).cast("int").alias("from_"))
    by_page = F.col("detector_name").isin(*BY_PAGE)
    placed = entries.filter(by_page).join(start, ["doc_id", "page_number", "block_ord"]).withColumns({"start": F.col("start") - F.col("from_"), "end": F.col("end") - F.col("from_")})
    return entries.filter(~by_page).unionByName(placed.select(*entries.columns))


@dataclass
class Review:
    """``native``: blocks; ``sources``: doc_id, source_path, source_sha256; ``ocr``: how documents are read where their text
    won't do; ``terms``: remembered terms; ``saved``: entries of plans saved before (``plans.read``)."""

    native: DataFrame
    sources: DataFrame
    policy: decision.Policy = field(default_factory=decision.get_policy)
    ocr: Ocr | None = None
    terms: DataFrame | None = None
    saved: DataFrame | None = None
    registry: Registry = field(default_factory=default_registry)
    pages: DataFrame | None = None

    def __post_init__(self) -> None:
        self.blocks: DataFrame | None = None
        self._base: DataFrame | None = None
        self._steps: list[Callable[[DataFrame], DataFrame]] = []

    def run(self, auto: bool = True, force_ocr: bool = False, restore: bool = True) -> Review:
        """Text, detection, context, fusion, suggestions, then saved decisions and remembered terms."""
        blocks = chosen_text(self.native, self.ocr, auto, force_ocr, self.pages)
        if "words" not in blocks.columns:
            blocks = blocks.withColumn("words", words_with_boxes(F.col("text"), F.col("bbox")))
        self.blocks = self._kept(blocks)
        found = self.registry.run(self.blocks, values_only=True)
        fused = fusion.fuse(context.apply(found, self.blocks))
        entries = decision.suggest(with_ids(fused), self.policy).join(self.sources.select("doc_id", "source_path", "source_sha256"), "doc_id", "left")
        if restore and self.saved is not None:
            old = self.saved.join(self.sources.select("doc_id", "source_sha256"), ["doc_id", "source_sha256"], "left_semi")
            entries = decision.restore(entries, self._aligned(old, entries))
        if self.terms is not None:
            entries = self._with(entries, session.remembered(self.blocks, self.terms, self.policy))
        self._base = self._kept(entries)
        self._steps = []
        return self

    def rerun(self, force_ocr: bool = True) -> Review:
        """Again, by OCR unless told otherwise; decisions and marks go."""
        return self.run(auto=False, force_ocr=force_ocr, restore=False)

    @staticmethod
    def _kept(rows: DataFrame) -> DataFrame:
        return rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows

    @staticmethod
    def _aligned(rows: DataFrame, like: DataFrame) -> DataFrame:
        there = set(rows.columns)
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in there else F.lit(0 if f.name.endswith("_ord") else None).cast(f.dataType).alias(f.name) for f in like.schema))

    def _with(self, entries: DataFrame, more: DataFrame) -> DataFrame:
        """The entries and those of ``more`` whose id their document doesn't have yet."""
        more = more.join(self.sources.select("doc_id", "source_path", "source_sha256"), "doc_id", "left")
        fresh = more.join(entries.select("doc_id", "detection_id"), ["doc_id", "detection_id"], "left_anti")
        return entries.unionByName(self._aligned(fresh, entries))

    @property
    def entries(self) -> DataFrame:
        if self._base is None:
            raise RuntimeError("the review has not been run")
        out = self._base
        for step in self._steps:
            out = step(out)
        return out

    def decide(self, decisions: DataFrame) -> Review:
        """Decisions (doc_id, detection_id, decision, decided_ord); a null clears."""
        self._steps.append(lambda e: decision.decide(e, decisions))
        return self

    def decide_all(self, condition: Column, what: str) -> Review:
        self._steps.append(lambda e: decision.decide_all(e, condition, what))
        return self

    def mark(self, terms: DataFrame, remember: bool = False) -> DataFrame:
        """Every place of the terms (term, label, case_sensitive) becomes an entry to redact. doc_id, added, skipped."""
        added, counts = session.mark(self.entries, session.instances(self.blocks, terms))
        added = self._kept(added)
        self._steps.append(lambda e: self._with(e, added))
        if remember:
            new = terms.withColumns({"added_from": F.lit(None).cast("string"), "ignored": F.lit(False)}).select("term", "label", "case_sensitive", "added_from", "ignored")
            self.terms = new if self.terms is None else session.add_terms(self.terms, new)
        return counts

    def unmark(self, detection_id: str) -> Review:
        self._steps.append(lambda e: session.remove_manual(e, detection_id))
        return self

    def forget(self, text: str, label: str) -> Review:
        if self.terms is not None:
            _, self.terms = session.forget(self.entries, self.terms, text, label)
        gone = (F.col("detector_name") == "remembered") & (session.folded(F.col("text")) == session.folded(F.lit(text))) & (F.col("detection_type") == label)
        self._steps.append(lambda e: e.filter(~gone))
        return self

    def undo(self) -> bool:
        """Takes the last step back; whether there was one. Remembered terms stay as they are."""
        return bool(self._steps and self._steps.pop())

    def counts(self) -> DataFrame:
        return decision.counts(self.entries)

    def pending(self) -> DataFrame:
        return decision.pending(self.entries)

    def save(self, path: str) -> str:
        """The plans, one JSON text a document, for ``plans.read`` and a later review's ``saved``."""
        plans.write(self.entries, self.policy.name, path)
        return path

    def redactions(self, redaction_type: str = redaction.REPLACE) -> DataFrame:
        """What is redacted: decisions, else suggestions, and what is still to ask about."""
        found = decision.resolve(self.entries, accept_suggestions=True)
        return redaction.plan(in_blocks(found, self.blocks), redaction_type)

    def apply(self, plan_path: str | None = None, redaction_type: str = redaction.REPLACE) -> DataFrame:
        """The blocks with redacted_text and n_redactions; the plan is saved as the record of what was decided."""
        if plan_path:
            self.save(plan_path)
        return redaction.redacted_blocks(self.blocks, self.redactions(redaction_type))

    def rendered(self, files: DataFrame, lines: DataFrame, renderer: rendering.Renderer, plain: rendering.Renderer | None = None, backgrounds: DataFrame | None = None) -> DataFrame:
        """doc_id, name, content, error: the files (doc_id, name, content) redacted as decided so far. ``lines`` are the parser's
        characters (``rendering.drawing``); boxes are fitted to the values and merged before they are drawn."""
        boxes = redaction.refined_boxes(self.redactions(), self.blocks)
        ordered = boxes.withColumns({"start": F.col("bbox.x0"), "end": F.col("bbox.x1"), "detection_type": F.lit(""), "block_ord": F.col("bbox.y0"), "detector_ord": F.lit(0), "pattern_ord": F.lit(0)})
        return rendering.render(files, rendering.drawing(lines, redaction.merged_jobs(ordered), backgrounds), renderer, plain)

    def preview(self, files: DataFrame, lines: DataFrame, renderer: rendering.Renderer, raster: Callable, dpi: float = 144.0) -> DataFrame:
        """Pictures of the pages as they would be redacted now."""
        done = self.rendered(files, lines, renderer)
        return rendering.page_images(done.filter("error IS NULL"), raster, dpi)
