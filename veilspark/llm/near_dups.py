"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Texts with the same words in the same order are one class; only its smallest doc_id goes on.
2. Each class has ``BANDS`` x ``ROWS`` MinHash values. Documents that share a band's hash are in one bucket. A bucket pairs
   each member with its smallest id (and in buckets of three the other two with each other), so pairs grow as members do.
3. A pair's signatures are compared in batches of ``BATCH`` values. With a uniform prior on the similarity, n compared values of
   which m agree leave P(similarity >= t) = P(Bin(n + 1, t) <= m); the pair is pruned as soon as that falls under ``miss``.
4. Survivors are confirmed on their full shingle sets. Confirmed links give components.
5. Buckets of four or more that still hold several components are compared in full across components, in blocks of
   members: members outside the component of the bucket's smallest id go to every block, those inside to one. The survivors
   of step 3 are confirmed there on their full sets, and components are taken again over all links.

A pair of similarity t shares no band with probability (1 - t**ROWS)**BANDS: 2.5e-7 at 0.8.

Edge cases: null or empty texts, and texts of white space, have the empty set and link with nothing; texts of fewer words
than a shingle have their whole sequence as one shingle; rows that repeat a doc_id get the same component; rows without a
doc_id keep component null and are kept; extra columns are ignored here and kept by ``first_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut, fresh, prepare, raw_texts

ROWS, BANDS = 6, 50
KEPT_VALUES, BATCH = 128, 16  # values of a signature that verification may compare, and how many at a time
BLOCK = 256  # members of a bucket in a block
FEW = 1_000_000  # ids (8 MB) that may be broadcast
_A = (np.random.default_rng(20240229).integers(1, 1 << 31, ROWS * BANDS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = np.random.default_rng(8271).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
SKETCH = "doc_id bigint, same binary, n_shingles bigint, bands array<bigint>, signature binary"


class Shingler:
    """Shingle sets of texts as sorted distinct 64-bit hashes. Words are lower-cased (A-Z) runs without ASCII white space.

    A word's hash is a difference of prefix sums of a polynomial over random byte values (mod 2**64), so a text is
    hashed by a few array operations and no word becomes an object."""

    _R = 0x9E3779B97F4A7C15 | 5
    _BYTES = np.random.default_rng(977).integers(0, 1 << 64, 256, dtype=np.uint64)
    _BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self, size: int):
        self.size = size
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            m = 1 << (n - 1).bit_length()
            back = pow(self._R, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.r_[np.uint64(1), np.full(m - 1, self._R, np.uint64)])
                self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(m - 1, back, np.uint64)])

    def words(self, text: bytes) -> np.ndarray:
        """A hash for each word, in order."""
        b = np.frombuffer(text.lower(), np.uint8)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~self._BLANK[b]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.zeros(0, np.uint64)
        self._powers(len(b))
        with np.errstate(over="ignore"):
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(self._BYTES[b] * self.power[: len(b)], out=total[1:])
            h = (total[end] - total[start]) * self.inverse[start] ^ (end - start).astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def set_of(self, h: np.ndarray) -> np.ndarray:
        """The distinct shingles of a text's word hashes."""
        if not len(h):
            return np.zeros(0, np.uint64)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
        return np.unique(out)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The ROWS x BANDS MinHash values of a set that isn't empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(best, (low[k : k + 1024, None] * _A + _B).min(axis=0), out=best)
    return best


def band_hashes(values: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            h = (h ^ values[j::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def pruning_bounds(t: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): with fewer than m of n values alike, the similarity is t or more with a probability under ``miss``."""
    out = []
    for n in range(BATCH, KEPT_VALUES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)  # P(Bin(n + 1, t) <= m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survive(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays survive all batches; pruned rows are not looked at again."""
    live, alike, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in bounds:
        alike = alike + (a[live, done:n] == b[live, done:n]).sum(axis=1)
        on = alike >= m
        live, alike, done = live[on], alike[on], n
        if not len(live):
            break
    return live


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, KEPT_VALUES)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(shingle)
        for batch in batches:
            same, n, bands, sig = [], [], [], []
            for text in raw_texts(batch):
                words = own.words(text)
                s = own.set_of(words)
                n.append(len(s))
                if len(s):
                    v = min_hashes(s)
                    same.append(xxhash.xxh3_128_digest(words.tobytes()))
                    bands.append(band_hashes(v))
                    sig.append(v[:KEPT_VALUES].astype(np.uint16).tobytes())
                else:
                    same.append(None), bands.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "same", "n_shingles", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def likely(pairs: DataFrame, reps: DataFrame, t: float, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential verification does not prune."""
    bounds = pruning_bounds(t, miss)
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("signature").alias("s" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # no set can be t-similar to one of less than t times its size
    both = both.filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(t - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live = survive(_signatures(batch.column(2)), _signatures(batch.column(3)), bounds) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live, pa.int64())), batch.column(1).take(pa.array(live, pa.int64()))], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def homes(multi: DataFrame) -> DataFrame:
    """id, block: documents of one neighbourhood (the smallest id that leads one of a document's buckets) in blocks of
    about BLOCK members, so that a set is sent once to a pair of blocks and not once to every pair of documents."""
    home = multi.groupBy("id").agg(F.min("lead").alias("home"))
    size = home.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
    return home.join(size, "home").select("id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("n_blocks"))).alias("block"))


def listed(ids: DataFrame, tag: str) -> DataFrame:
    """A list of ids written once; broadcast where it has at most FEW, else joined by shuffling."""
    ids = cut(ids.distinct(), tag)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def full_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """id, shingles of the documents listed."""
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(shingle)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.set_of(own.words(x)).tobytes() for x in raw_texts(batch)], pa.binary())], names=["id", "shingles"])

    return cut(wanted.mapInArrow(sets, "id bigint, shingles binary"), "sets")


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    common = int((q[at] == p).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def confirmed(pairs: DataFrame, blocks: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike. Pairs are dealt into cells of two blocks; the sets that a cell needs come once,
    before its pairs."""
    side = lambda x: blocks.select(F.col("id").alias(x), F.col("block").alias("block_" + x))
    placed = cut(pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y"), "a", "b"), "placed")
    need = placed.select("x", "y", F.explode(F.array("a", "b")).alias("a")).distinct().join(full.withColumnRenamed("id", "a"), "a")
    none = F.lit(None).cast("bigint")
    rows = need.select("x", "y", F.col("a"), none.alias("b"), "shingles").unionByName(placed.select("x", "y", "a", "b", F.lit(None).cast("binary").alias("shingles")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            a_out, b_out = [], []
            for x, y, a, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x, y) != now:
                    now, held = (x, y), {}
                if b is None:
                    held[a] = np.frombuffer(data, np.uint64)
                    continue
                if alike(held[a], held[b], percent):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("x", "y").sortWithinPartitions("x", "y", F.col("b").asc_nulls_first())
    return dealt.select("x", "y", "a", "b", "shingles").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) for every id in the links (a, b): alternating large and small stars, each round
    written to the shared folder, until the edges no longer change."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def _across(multi: DataFrame, reps: DataFrame, full: DataFrame, comp: DataFrame, percent: int, miss: float) -> DataFrame:
    """Step 5: links across components in buckets that hold several. A pair is looked at in the first of its common bands
    only; buckets of two and three members have been compared in full before."""
    spark, t = multi.sparkSession, percent / 100
    at = multi.filter("n > 3").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = at.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("id", "component"))["component"].alias("main")).filter("low <> high").select("bucket", "main")
    mixed = cut(mixed, "mixed_buckets")
    rows = cut(at.join(mixed, "bucket").select("bucket", "id", "component", (F.col("component") == F.col("main")).alias("inside")), "mixed")
    sizes = rows.groupBy("bucket").agg(F.ceil(F.sum(F.col("inside").cast("int")) / BLOCK).alias("in_blocks"), F.ceil(F.sum((~F.col("inside")).cast("int")) / BLOCK).alias("out_blocks"))
    rows = rows.join(sizes, "bucket").join(reps.select("id", F.col("n").alias("size"), "signature", "bands"), "id")
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    # Cells: (inside block, outside block) and pairs of outside blocks; a member inside stands in one row of cells.
    inside = rows.filter("inside").withColumn("x", pick("in_blocks")).select("*", F.explode(F.expr("sequence(0L, out_blocks - 1)")).alias("y")).withColumn("x", -1 - F.col("x"))
    outside = rows.filter("not inside").withColumn("own", pick("out_blocks"))
    to_in = outside.select("*", F.explode(F.expr("sequence(1L, in_blocks)")).alias("x0")).select(*outside.columns, (-F.col("x0")).alias("x"), F.col("own").alias("y"))
    to_out = outside.select("*", F.explode(F.expr("sequence(0L, out_blocks - 1)")).alias("o")).select(*outside.columns, F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"))
    order, names = ["bucket", "x", "y"], ["bucket", "x", "y", "id", "component", "size", "signature", "bands"]
    cells = inside.select(*names).unionByName(to_in.select(*names)).unionByName(to_out.select(*names))
    bounds = pruning_bounds(t, miss)

    def surviving(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the pairs in each cell that survive and have their first common band there."""
        cell = np.stack([table.column(k).to_numpy() for k in order], axis=1)
        comp_, size = (table.column(k).to_numpy() for k in ("component", "size"))
        sig = _signatures(table.column("signature"))
        band = table.column("bands").combine_chunks().values.to_numpy().reshape(-1, BANDS)
        edge = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1), True])
        for lo, hi in zip(edge, edge[1:], strict=False):
            p, q = np.triu_indices(hi - lo, 1)
            p, q = p + lo, q + lo
            on = (comp_[p] != comp_[q]) & (np.minimum(size[p], size[q]) >= np.maximum(size[p], size[q]) * (t - 1e-9))
            p, q = p[on], q[on]
            live = survive(sig[p], sig[q], bounds)
            p, q = p[live], q[live]
            here = band[p, (band[p] == band[q]).argmax(axis=1)] == cell[lo, 0]
            if here.any():
                yield p[here], q[here]

    def cellwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows come sorted by cell; a cell's members (at most about two blocks) are put together."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            tail = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1  # where the last cell begins
            if tail:
                yield pa.Table.from_batches([*held, batch.slice(0, tail)])
                held = []
            held.append(batch.slice(tail))
        if held:
            yield pa.Table.from_batches(held)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cellwise(batches):
            hit = [np.concatenate(x) for x in surviving(table)]
            if hit:
                yield from table.select(names).take(np.unique(np.concatenate(hit))).combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cellwise(batches):
            ids, data, a, b = table.column("id").to_numpy(), table.column("shingles"), [], []
            for p, q in surviving(table):
                sets = {k: np.frombuffer(data[k].as_py(), np.uint64) for k in set(p.tolist()) | set(q.tolist())}
                for i, j in zip(p.tolist(), q.tolist(), strict=True):
                    if alike(sets[i], sets[j], percent):
                        a.append(min(ids[i], ids[j]))
                        b.append(max(ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    prepare(spark)
    deal = lambda df: df.repartition(*order).sortWithinPartitions(*order)
    # Signatures first: only members with a surviving pair in a cell bring their full sets there.
    few = cut(deal(cells).select(*names).mapInArrow(members, "bucket bigint, x bigint, y bigint, id bigint, component bigint, size bigint, signature binary, bands array<bigint>"), "members")
    again = few.join(full, "id")
    return deal(again.select(*names, "shingles")).mapInArrow(links, "a bigint, b bigint").distinct()


def link(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    t = percent / 100
    sketch = cut(sketches(docs, shingle), "sketches")
    some = sketch.filter(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    # Classes of one member need no row: only repeated texts are listed, and all but the smallest id of each stay out.
    first = cut(some.groupBy("same").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("same", "id"), "classes")
    copies = listed(some.select("same", "doc_id").join(first, "same").filter("doc_id <> id").select("doc_id"), "copies")
    reps = some.join(copies, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "signature")
    rows = reps.select("id", F.explode("bands").alias("bucket"))
    often = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).filter("n > 1"), "often")
    multi = cut(rows.join(often, "bucket").select("bucket", "id", "n", "lead"), "buckets")
    ids = listed(multi.select("id"), "candidates")
    reps = cut(reps.join(ids, "id", "left_semi"), "candidate_sketches")
    star = multi.select(F.col("lead").alias("a"), F.col("id").alias("b"))
    third = multi.filter("n = 3").groupBy("bucket").agg(F.max("id").alias("b"), (F.sum("id") - F.max("id") - F.min("id")).alias("a")).select("a", "b")
    pairs = star.unionByName(third).filter("a < b").distinct()
    blocks = homes(multi)
    full = full_sets(ids, docs, shingle)
    links = cut(confirmed(likely(pairs, reps, t, miss), blocks, full, percent), "links")
    comp = components(links)
    more = cut(_across(multi, reps, full, comp, percent, miss), "across")
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    known = sketch.select("doc_id", "n_shingles", "same").join(first, "same", "left").withColumn("id", F.coalesce("id", "doc_id"))
    member = known.join(comp, "id", "left")
    component = F.coalesce("component", "id")
    return member.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """The documents without those that a document of smaller id stands for, with their columns as they were."""
    gone = fresh(docs, "gone")
    out = cut(link(docs, shingle, percent, miss).filter("not kept").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return docs.join(out, docs["doc_id"] == out[gone], "left_anti")


#: component_id by following links; every pair with a common shingle is counted, so for small tables only.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
