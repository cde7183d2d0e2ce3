"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of L characters that occurs in a text with at most k edits shares at least L - q + 1 - k q of its q-grams with the
text, all of them on diagonals (text position minus item position) that lie within k of each other. Shared q-grams are
counted in bands of 2w diagonals that overlap by half (w >= k), so some band holds them all; bands that reach the bound
are aligned, within the band's diagonals only, and count if the edit distance is at most k. k is ``error_rate`` times L,
less for short items, so that the bound is at least 1; items shorter than q are searched for as they are.

Texts and items are compared in lower case with white space as blanks. Items are broadcast in blocks of at most
``block_chars`` characters, each against all documents.

Edge cases: null and empty texts match nothing; null and empty items match nothing; repeated items are matched
each under its own id, with the smallest id reported first; a document of any length is read whole, in windows that
overlap by more than the longest item and are at least four times as long; repeated documents are matched like any other; extra columns stay in ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import prepare, texts

Q = 8  # characters in a q-gram; eight symbols fill a 64-bit word
SPACES = [0x85, 0xA0, 0x2028, 0x2029]
WINDOW = 1 << 20
MATCHES = "doc_id bigint, item_id bigint, edits bigint, match_start bigint, match_end bigint, n_chars bigint"


def normal(text: str) -> np.ndarray:
    """Lower-case code points, white space as blanks."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 9) & (a <= 13)] = 32
    if not text.isascii():
        a[np.isin(a, SPACES)] = 32
    return a


def symbols(a: np.ndarray) -> np.ndarray:
    """A byte from 1 to 255 for each code point; equal points give equal bytes."""
    return ((a ^ (a >> np.uint32(8))) % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def codes(s: np.ndarray) -> np.ndarray:
    """The q-gram at each position, as a 64-bit word."""
    x = s.astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return x[:-4] << np.uint64(32) | x[4:]


class Items:
    """Benchmark items with the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        items = sorted((i, t) for i, t in items if t and t.strip())
        self.ids = np.array([i for i, _ in items], np.int64)
        self.chars = [normal(t) for _, t in items]
        self.size = np.array([len(c) for c in self.chars], np.int64)
        self.k = np.minimum((self.size * error_rate).astype(np.int64), np.maximum(0, (self.size - Q) // Q))
        self.w = np.maximum(self.k, 4)
        self.bound = self.size - Q + 1 - self.k * Q
        self.short = [(n, t.lower()) for n, (_, t) in enumerate(items) if len(self.chars[n]) < Q]
        whole = [n for n in range(len(items)) if self.size[n] >= Q]
        grams = [codes(symbols(self.chars[n])) for n in whole]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(whole, [len(g) for g in grams]).astype(np.int64)
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.keys, self.at = np.unique(flat[order], return_index=True)
        self.many = np.diff(np.append(self.at, len(flat)))
        self.there = np.zeros(1 << 22, np.bool_)
        self.there[self._slot(self.keys)] = True
        self.reach = int((self.size + 3 * self.w).max() + Q) if len(items) else Q

    @staticmethod
    def _slot(c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def match(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, start, end) of the best occurrence of each item in each of the texts."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            for doc, item, edits, a, b in self._match(held):
                if (doc, item) not in best or (edits, a, b) < best[doc, item]:
                    best[doc, item] = (edits, a, b)

        window = max(WINDOW, 4 * self.reach)  # so that a step is at least half a window, however long an item is
        for d, a in enumerate(docs):
            for start in range(0, max(1, len(a)), window - 2 * self.reach):
                part = a[start : start + window]
                if start and len(part) <= 2 * self.reach:
                    break
                held.append((d, start, part))
                size += len(part)
                if size >= window:
                    flush()
                    held, size = [], 0
        flush()
        return [(d, n, *x) for (d, n), x in sorted(best.items())]

    def _match(self, parts: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
        if not parts or not len(self.ids):
            return
        for n, t in self.short:
            for d, off, a in parts:
                text = a.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                if (p := text.find("".join(map(chr, self.chars[n])))) >= 0:
                    yield d, n, 0, off + p, off + p + len(t)
        gap = np.zeros(Q, np.uint32)
        flat = np.concatenate([x for _, _, a in parts for x in (a, gap)])
        sizes = np.array([len(a) + Q for _, _, a in parts])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        s = symbols(flat)
        for f, z in zip(first, sizes, strict=True):
            s[f + z - Q : f + z] = 0
        c = codes(s)
        hit = np.flatnonzero(self.there[self._slot(c)])
        key = np.searchsorted(self.keys, c[hit])
        key[key == len(self.keys)] = 0
        on = self.keys[key] == c[hit]
        hit, key = hit[on], key[on]
        if not len(hit):
            return
        many = self.many[key]
        run = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        occ = np.repeat(self.at[key], many) + run
        item, pos, diag = self.item[occ], self.pos[occ], np.repeat(hit, many) - self.pos[occ]
        part = np.repeat(np.searchsorted(first, hit, side="right") - 1, many)
        # A band is w diagonals and the w after them; each q-gram counts in two bands, once however often it occurs there.
        band = (diag - first[part]) // self.w[item]
        lo = int(band.min()) - 1
        span, n_items = int(band.max()) - lo + 2, len(self.ids)
        keys = []
        for shift in (0, 1):
            cell = (part * n_items + item) * span + (band - shift - lo)
            keys.append(cell)
        cell, place = np.concatenate(keys), np.concatenate([pos, pos])
        # Cheap count first (with repeats), then distinct q-grams in the cells that may reach the bound.
        uniq, inv, n = np.unique(cell, return_inverse=True, return_counts=True)
        may = n >= self.bound[(uniq // span) % n_items]
        sel = may[inv]
        if not sel.any():
            return
        width = int(self.size.max()) + 1
        cell = np.unique(cell[sel] * width + place[sel]) // width
        cell, n = np.unique(cell, return_counts=True)
        cell = cell[n >= self.bound[(cell // span) % n_items]]
        if not len(cell):
            return
        part, item, band = cell // span // n_items, (cell // span) % n_items, cell % span + lo
        order = np.argsort(self.size[item], kind="stable")  # so that a long item does not widen the rows of short ones
        part, item, band = part[order], item[order], band[order]
        k = 0
        while k < len(cell):
            n = 2048
            while n > 1 and n * self.size[item[min(k + n, len(cell)) - 1]] > 1 << 24:
                n //= 2
            yield from self._align(parts, flat, first, sizes, part[k : k + n], item[k : k + n], band[k : k + n])
            k += n

    def _align(self, parts, flat, first, sizes, part, item, band) -> Iterator[tuple[int, int, int, int, int]]:  # noqa: ANN001
        """Edit distance of items to substrings of the texts, on the diagonals of their bands."""
        n, L = len(item), int(self.size[item].max())
        wide = 2 * self.w[item] + 1
        W = int(wide.max())
        text = np.full((n, L), 0, np.uint32)
        for r, x in enumerate(item):
            text[r, : self.size[x]] = self.chars[x]
        diag0 = band * self.w[item] + first[part]
        lo, hi = first[part], first[part] + sizes[part] - Q
        off = np.arange(W)[None, :]
        big = np.int32(1 << 20)
        in_band = off < wide[:, None]
        j = diag0[:, None] + off  # text position before which the alignment starts
        d = np.where(in_band & (j >= lo[:, None]) & (j <= hi[:, None]), 0, big).astype(np.int32)
        start = j.astype(np.int64)
        out, out_at, out_start = np.full(n, big), np.zeros(n, np.int64), np.zeros(n, np.int64)
        slope = np.arange(W, dtype=np.int32)[None, :]
        for i in range(1, L + 1):
            j = diag0[:, None] + off + i
            ok = in_band & (j > lo[:, None]) & (j <= hi[:, None])
            seen = flat[np.clip(j - 1, 0, len(flat) - 1)]
            sub = d + (seen != text[:, i - 1 : i])
            skip = np.concatenate([d[:, 1:], np.full((n, 1), big)], axis=1) + 1  # an item character without a partner
            skip_start = np.concatenate([start[:, 1:], start[:, -1:]], axis=1)
            here = in_band & (j >= lo[:, None]) & (j <= hi[:, None])
            cur = np.where(ok, np.minimum(sub, skip), np.where(here, skip, big)).astype(np.int32)
            cur_start = np.where(ok & (sub <= skip), start, skip_start)
            # a text character without a partner: from the left in the row
            run = np.minimum.accumulate(cur - slope, axis=1) + slope
            if (run < cur).any():
                come = np.maximum.accumulate(np.where(run == cur, slope, 0), axis=1)
                cur_start = np.take_along_axis(cur_start, come.astype(np.int64), axis=1)
                cur = np.where(here, run, big)
            d, start = cur, cur_start
            done = np.flatnonzero(self.size[item] == i)
            if len(done):
                b = d[done].argmin(axis=1)
                out[done], out_at[done], out_start[done] = d[done, b], diag0[done] + b + i, start[done, b]
        for r in np.flatnonzero(out <= self.k[item]):
            doc, shift, _ = parts[part[r]]
            yield doc, int(item[r]), int(out[r]), int(out_start[r] - lo[r] + shift), int(out_at[r] - lo[r] + shift)


def item_blocks(benchmark: DataFrame, error_rate: float, block_chars: int) -> Iterator[Items]:
    """The items in blocks of about ``block_chars`` characters, one after the other."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // block_chars + 1
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        yield Items([(r[0], r[1]) for r in part.collect()], error_rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """A row for each (document, item) pair found: the fewest edits and where in the document (characters)."""
    spark = prepare(docs.sparkSession)
    out: DataFrame | None = None
    for items in item_blocks(benchmark, error_rate, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = shared.value
            for batch in batches:
                docs_, whole = batch.column(0).to_pylist(), [normal(x) for x in texts(batch)]
                got = own.match(whole)
                cols = [[docs_[g[0]] for g in got], [int(own.ids[g[1]]) for g in got], *([g[k] for g in got] for k in (2, 3, 4)), [len(whole[g[0]]) for g in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "match_start", "match_end", "n_chars"])

        found = docs.select("doc_id", "text").mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """The documents in which no item occurs, with their columns as they were."""
    spark = prepare(docs.sparkSession)
    names = docs.columns
    for items in item_blocks(benchmark, error_rate, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                bad = {g[0] for g in shared.value.match([normal(x) for x in texts(batch)])}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*names)
