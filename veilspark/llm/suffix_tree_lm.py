r"""Language-model scoring with a probabilistic suffix tree.

The tree reads a text as the bytes of its tokens: every word with a blank after it, then ``\n`` for the end. Byte contexts of
up to ``DEPTH`` symbols are counted over all training documents. A context stays if it was seen at least ``min_count`` times,
a number that does not depend on the corpus, and its next-symbol distribution diverges from that of its longest proper
suffix: count x KL >= ``min_gain``. Suffixes of what stays, stay, and so do all contexts of up to ``LOW`` bytes. Each
distribution is smoothed towards its suffix's: (counts + strength P_suffix) / (total + strength). A byte is scored by the
longest suffix of the text before it that is a context. ``score`` is the sum of the bytes' log10 probabilities, unknown words
spelled out like any other.

The tree grows with the corpus and is nowhere held whole. Documents are dealt by hash of id and text into blocks of about
``BLOCK`` bytes, one to a task. A block asks for its distinct n-grams of DEPTH + 1 bytes, with their counts in its training
documents, and for its distinct words. N-grams are dealt into parts by the last LOW + 1 bytes of their context, so that a
part holds all that its contexts' counts, suffixes and divergences need; counts for contexts of up to LOW bytes (at most
2**24) are broadcast. Words are dealt into parts by hash. A part answers with the log probability of each n-gram, and the
count of each word, that was asked for, and documents and answers meet again block by block. Questions and answers travel
packed, a row for each block and part; no n-gram and no word is a row. Log probabilities travel in 16 bits, in steps of
1/3000 of a decade down to 10**-21.8, so ``score`` is right to about 1/6000 for each byte.

Edge cases: null texts are empty, an empty text is the end token alone; a null id counts as the empty text in the split; rows
that repeat are scored alike (and trained on as often as they stand there); with nothing to learn from, N = V = 0, all tokens
are unknown and every byte has the probability 1/256; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut, prepare, py_crc_mod, uncut

BLOCK = 10 << 20  # bytes of text in a block
DEPTH = 7  # an n-gram, context and symbol, fills a 64-bit word
LOW = 2  # contexts of up to this many bytes are broadcast
END = b""  # how the end token is kept in tables of words
PAD = b"\n" * DEPTH
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only); bytes.split() and bytes.lower() know ASCII alone."""
    return text.lower().split()


def spell(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else b"\n"


def held_out(doc_id: int | None) -> bool:
    return py_crc_mod(doc_id, 5) == 1


def keys_of(spelled: list[bytes]) -> np.ndarray:
    """A 64-bit word for each byte of the texts: the DEPTH bytes before it, the last one first, and the byte itself."""
    data = b"".join(PAD + d for d in spelled)
    size = np.array([len(d) + DEPTH for d in spelled])
    keep = np.ones(len(data), bool)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    for j in range(DEPTH):
        keep[first + j] = False
    # eight bytes from each place on, the first the lowest: the symbol is the highest and moves to the end
    eight = np.ndarray((len(data) - DEPTH,), "<u8", data, 0, (1,))[keep[DEPTH:]]
    return eight << np.uint64(8) | eight >> np.uint64(56)


def all_keys(spelled: list[bytes]) -> np.ndarray:
    """``keys_of`` in one array, made in pieces of about a megabyte."""
    out, at = np.empty(sum(map(len, spelled)), np.uint64), 0
    for first, end in _pieces(spelled):
        own = keys_of(spelled[first:end])
        out[at : at + len(own)] = own
        at += len(own)
    return out


def _pieces(spelled: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """First and end of runs of texts of about ``most`` bytes."""
    first, size = 0, 0
    for k, d in enumerate(spelled):
        size += len(d) + DEPTH
        if size >= most:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(spelled):
        yield first, len(spelled)


def tree_scores(spelled: list[bytes], logs_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of each text's log probabilities; ``logs_of`` has them for sorted distinct n-grams.

    Eight bytes of R distinct values and a text's number fit a 64-bit word where R**8 x texts does; then one sort brings equal
    n-grams together and each still knows its text. Otherwise each piece of the texts is sorted by an index."""
    used = np.flatnonzero(np.bincount(np.frombuffer(b"".join([PAD, *spelled]), np.uint8), minlength=256))
    R, bits = len(used), len(spelled).bit_length()
    if R**8 << bits > 1 << 64:
        pieces = [(first, end, *grouped(keys_of(spelled[first:end]))[::2]) for first, end in _pieces(spelled)]
        keys = np.sort(np.concatenate([x[2] for x in pieces]))
        keys = keys[_starts(keys)]
        logs, out = logs_of(keys), np.zeros(len(spelled))
        for first, end, own, inv in pieces:
            size = np.fromiter(map(len, spelled[first:end]), np.int64, end - first)
            out[first:end] = np.add.reduceat(logs[np.searchsorted(keys, own)][inv].astype(np.float64), np.cumsum(size) - size)
        return out
    rank = np.zeros(256, np.uint64)
    rank[used] = np.arange(R)
    power = [np.uint64(R**k) for k in range(7)]
    both, at = np.empty(sum(map(len, spelled)), np.uint64), 0
    for first, end in _pieces(spelled):
        data = b"".join(PAD + d for d in spelled[first:end])
        size = np.fromiter(map(len, spelled[first:end]), np.int64, end - first)
        r = rank[np.frombuffer(data, np.uint8)]
        two = r[:-1] + r[1:] * power[1]
        four = two[:-2] + two[2:] * power[2]
        # the context's last byte is the highest, the symbol the lowest, as in keys_of
        eight = (four[:-4] + two[4:-2] * power[4] + r[6:-1] * power[6]) * power[1] + r[7:]
        keep = np.ones(len(data), bool)
        start = np.cumsum(size + DEPTH) - (size + DEPTH)
        for j in range(DEPTH):
            keep[start + j] = False
        own = eight[keep[DEPTH:]] << np.uint64(bits) | np.repeat(np.arange(first, end, dtype=np.uint64), size)
        both[at : at + len(own)] = own
        at += len(own)
    both.sort()
    first = np.flatnonzero(_starts(both >> np.uint64(bits)))
    code = both[first] >> np.uint64(bits)
    keys = np.zeros(len(code), np.uint64)
    for j in range(8):
        code, digit = np.divmod(code, power[1])
        keys |= used.astype(np.uint64)[digit.astype(np.intp)] << np.uint64(8 * j)
    logs = logs_of(keys)
    del keys, code, digit
    logs = np.repeat(logs, np.diff(first, append=len(both)))
    out = np.zeros(len(spelled))
    for k in range(0, len(both), 1 << 20):
        text = both[k : k + (1 << 20)] & np.uint64((1 << bits) - 1)
        out += np.bincount(text.astype(np.intp), logs[k : k + (1 << 20)], len(spelled))
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts, of sorted parts."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")  # quick on sorted runs
    keys, n = keys[order], n[order]
    first = np.flatnonzero(_starts(keys))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number of each element's value. (np.unique takes several times as long.)"""
    order = np.argsort(x)
    x = x[order]
    new = _starts(x)
    inv = np.empty(len(x), np.int32)
    inv[order] = np.cumsum(new) - 1
    return x[new], order[new], inv


def _starts(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length, compressed by planes of bytes."""
    import zstandard

    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(packed: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    width = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(flat) // sum(width), 0, []
    for k, w in zip(kinds, width, strict=True):
        out.append(np.ascontiguousarray(flat[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


def pack_counts(keys: np.ndarray, n: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), n.astype(np.int64))


def unpack_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = unpack(packed, np.uint64, np.int64)
    return np.cumsum(step, dtype=np.uint64), n


def pack_words(words: list[bytes], n: np.ndarray) -> bytes:
    """Words (without white space) and their counts."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<Q", len(words)) + n.astype("<i8").tobytes() + b"\n".join(words))


def unpack_words(packed: bytes) -> tuple[list[bytes], np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(packed)
    (k,) = struct.unpack_from("<Q", data)
    return data[8 + 8 * k :].split(b"\n") if k else [], np.frombuffer(data, "<i8", k, 8)


def tokens_of(spelled: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The number of each token, all texts together, and the distinct tokens (the end is END). Every token ends at a blank or
    a newline, so the texts are the buffer of an Arrow column whose equal values get one number; no token becomes an object."""
    data = b"".join(spelled)
    at = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero((at == 32) | (at == 10)) + 1
    offsets = pa.py_buffer(np.concatenate([[0], edge]).astype(np.int64))
    column = pa.Array.from_buffers(pa.large_binary(), len(edge), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    return column.indices.to_numpy(), [w[:-1] for w in column.dictionary.to_pylist()]


def words_by_part(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct words by part that does not depend on the order they come in, and where each part starts in it."""
    crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    key = crc % np.uint64(parts) << np.uint64(32) | crc
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(~_starts(key))  # few: words of one checksum go by themselves
    for first in same[~np.isin(same - 1, same)].tolist():
        end = int(np.searchsorted(key, key[first], "right"))
        order[first - 1 : end] = sorted(order[first - 1 : end].tolist(), key=words.__getitem__)
    return order, np.searchsorted(key >> np.uint64(32), np.arange(parts + 1))


STEP = 3000  # log10 probabilities travel in 16 bits: steps of 1/3000, down to -21.8


def pack_logs(logs: np.ndarray) -> bytes:
    return pack(np.minimum(np.rint(logs * -STEP), 65535).astype(np.uint16))


def unpack_logs(packed: bytes) -> np.ndarray:
    return unpack(packed, np.uint16)[0].astype(np.float32) / -STEP


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted keys by part, and where each part starts in it."""
    with np.errstate(over="ignore"):
        part = ((keys >> np.uint64(8 * (DEPTH - LOW))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text (UTF-8), block: the documents, each block a partition of its own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    block = F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("binary").alias("text"), block.alias("block"))


ASKED = "block int, part int, grams binary, words binary, n_tokens bigint, n_train bigint"


def asked(docs: DataFrame, blocks: int, parts: int, chunk: int = 16 << 20) -> DataFrame:
    """block, part, grams, words: the block's distinct n-grams and words of a part with their counts in its training
    documents (0 where only documents held out have them). Part -1 has the counted n-grams of LOW bytes of context,
    n_tokens and n_train, the training tokens and documents."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, n_tokens, n_train = None, 0, 0, 0
        held: dict[bool, list[bytes]] = {False: [], True: []}
        store: list[tuple[np.ndarray, np.ndarray]] = []
        total: dict[bytes, int] = {}

        def count() -> None:
            nonlocal size
            for out, spelled in held.items():
                if spelled:
                    codes, words = tokens_of(spelled)
                    if out:
                        for w in words:
                            total.setdefault(w, 0)
                    else:
                        own = zip(words, np.bincount(codes).tolist(), strict=True)
                        total.update(own if not total else [(w, total.get(w, 0) + k) for w, k in own])
                    del codes, words
                    keys = all_keys(spelled)
                    keys.sort()
                    first = np.flatnonzero(_starts(keys))
                    n = np.diff(first, append=len(keys)).astype(np.int32)
                    store.append((keys[first], np.zeros_like(n) if out else n))
                    spelled.clear()
            size = 0
            if len(store) >= 8:
                store[:] = [merged(store)]

        for batch in batches:
            for doc, text, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                words = words_of(text)
                out = held_out(doc)
                if not out:
                    n_tokens += len(words) + 1
                    n_train += 1
                held[out].append(spell(words))
                size += len(held[out][-1])
                if size >= chunk:
                    count()
        if block is None:
            return
        count()
        keys, n = merged(store)
        store.clear()
        low = pack_counts(*low_grams(keys, n))
        yield _rows([(block, -1, low, None, n_tokens, n_train)])
        total.pop(END)
        words, n_words = list(total), np.fromiter(total.values(), np.int64, len(total))
        del total
        order, at = by_part(keys, parts)
        by_word, word_at = words_by_part(words, parts)
        rows = []
        for p in range(parts):
            pick, own = order[at[p] : at[p + 1]], by_word[word_at[p] : word_at[p + 1]]
            if len(pick) or len(own):
                grams = pack_counts(keys[pick], n[pick]) if len(pick) else None
                rows.append((block, p, grams, pack_words([words[k] for k in own.tolist()], n_words[own]) if len(own) else None, None, None))
            if len(rows) >= 64:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    return cut(in_blocks(docs, blocks).repartitionById(blocks, "block").mapInArrow(run, ASKED), "asked")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["block", "part", "grams", "words", "n_tokens", "n_train"])


def low_grams(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counted n-grams of LOW bytes of context and a symbol."""
    on = n > 0
    low = keys[on] >> np.uint64(8 * (DEPTH - LOW + 1)) << np.uint64(8) | keys[on] & np.uint64(255)
    order = np.argsort(low, kind="stable")
    low = low[order]
    first = np.flatnonzero(_starts(low))
    return low[first], np.add.reduceat(n[on][order], first) if len(first) else n[:0]


class LowLevels:
    """Counts for contexts of up to LOW bytes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.grams, self.totals = [], []
        for k in range(LOW + 1):
            ctx = keys >> np.uint64(8 * (LOW - k + 1))
            for of, to in ((ctx << np.uint64(8) | keys & np.uint64(255), self.grams), (ctx, self.totals)):
                u, inv = np.unique(of, return_inverse=True)
                to.append((u, np.bincount(inv, weights=n, minlength=len(u))))

    @staticmethod
    def _count(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
        u, n = table
        if not len(u):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(u, key), len(u) - 1)
        return np.where(u[at] == key, n[at], 0.0)

    def prob(self, low: np.ndarray, strength: float) -> np.ndarray:
        """Smoothed probability of the symbol of each n-gram after its LOW bytes of context."""
        p = np.full(len(low), 1 / 256)
        for k in range(LOW + 1):
            ctx = low >> np.uint64(8 * (LOW - k + 1))
            p = (self._count(self.grams[k], ctx << np.uint64(8) | low & np.uint64(255)) + strength * p) / (self._count(self.totals[k], ctx) + strength)
        return p


def solve(keys: np.ndarray, n: np.ndarray, low: LowLevels, min_count: int, min_gain: float, strength: float) -> np.ndarray:
    """log10 probability of the last byte of each n-gram (sorted, distinct) after its longest context in the tree. ``keys``
    holds every counted n-gram of its contexts; what was not counted has n = 0."""
    sym = keys & np.uint64(255)
    before, _, at = grouped(keys >> np.uint64(8 * (DEPTH - LOW + 1)) << np.uint64(8) | sym)
    prob = low.prob(before, strength)
    out = prob[at]
    levels = []
    for k in range(LOW + 1, DEPTH + 1):
        gram, first, inv = grouped(keys >> np.uint64(8 * (DEPTH - k + 1)) << np.uint64(8) | sym)
        count = np.bincount(inv, weights=n, minlength=len(gram))
        ctx = gram >> np.uint64(8)
        new = _starts(ctx)
        of = np.cumsum(new) - 1
        total = np.bincount(of, weights=count)
        parent = prob[at[first]]
        prob = (count + strength * parent) / (total[of] + strength)
        # symbols never counted here keep the share ``rest`` of their probability after the suffix
        rest = strength / (total + strength)
        unseen = np.maximum(0.0, 1 - np.bincount(of, weights=parent))
        gain = total * (np.bincount(of, weights=prob * np.log(prob / parent)) + unseen * rest * np.log(rest))
        levels.append((ctx[new], (total >= min_count) & (gain >= min_gain), of, inv, prob))
        at = inv
    for shorter, longer in zip(levels[-2::-1], levels[:0:-1], strict=True):  # suffixes of what stays, stay
        shorter[1][np.searchsorted(shorter[0], longer[0][longer[1]] >> np.uint64(8))] = True
    for _, keep, of, inv, p in levels:
        out = np.where(keep[of][inv], p[inv], out)
    return np.log10(out).astype(np.float32)


def low_levels(rows: DataFrame) -> LowLevels:
    """The low levels of all blocks, merged in two rounds before the driver sees them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merged([])
        for batch in batches:
            own = merged([own, *map(unpack_counts, batch.column(0).to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array([pack_counts(*own)], pa.binary())], names=["grams"])

    low = rows.filter("part = -1").select("grams").mapInArrow(gather, "grams binary")
    low = low.repartitionById(16, F.pmod(F.xxhash64("grams"), F.lit(16)).cast("int")).mapInArrow(gather, "grams binary")
    return LowLevels(*merged([unpack_counts(r[0]) for r in low.collect()]))


def answered_grams(rows: DataFrame, parts: int, min_count: int, min_gain: float, strength: float, some: int = 2_000_000) -> DataFrame:
    """block, part, logs: log10 probabilities of the n-grams that the block asked for, in their order."""
    shared = rows.sparkSession.sparkContext.broadcast(low_levels(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, packed, store, size, part = [], [], [], 0, None
        for batch in batches:
            for block, part, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                blocks.append(block)
                packed.append(x)
                store.append(unpack_counts(x))
                size += len(store[-1][0])
                if size >= some:
                    store = [merged(store)]
                    size = 0
        if not blocks:
            return
        keys, n = merged(store)
        store.clear()
        logs = solve(keys, n, shared.value, min_count, min_gain, strength)
        del n
        for block, x in zip(blocks, packed, strict=True):
            own = pack_logs(logs[np.searchsorted(keys, unpack_counts(x)[0])])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([own], pa.binary())], names=["block", "part", "logs"])

    asking = rows.filter("part >= 0 AND grams IS NOT NULL").select("block", "part", "grams")
    return asking.repartitionById(parts, "part").mapInArrow(run, "block int, part int, logs binary")


def answered_words(rows: DataFrame, parts: int) -> DataFrame:
    """block, part, counts: counts in all training tokens of the words that the block asked for, in their order. A row
    without a block for each part: n_words, the distinct words that training has (the end token not among them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        asking: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asking.append(row)
                words, n = unpack_words(row[2])
                for w, k in zip(words, n.tolist(), strict=True):
                    total[w] += k
        for block, part, x in asking:
            words = unpack_words(x)[0]
            yield answer(block, part, pack(np.fromiter(map(total.__getitem__, words), np.int64, len(words))), None)
        yield answer(None, None, None, sum(x > 0 for x in total.values()))

    def answer(block: int | None, part: int | None, counts: bytes | None, n: int | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([counts], pa.binary()), pa.array([n], pa.int64())], names=["block", "part", "counts", "n_words"])

    asking = rows.filter("part >= 0 AND words IS NOT NULL").select("block", "part", "words")
    return cut(asking.repartitionById(parts, "part").mapInArrow(run, "block int, part int, counts binary, n_words bigint"), "words")


def score(docs: DataFrame, min_count: int = 2, min_gain: float = 12.0, strength: float = 4.0, block_bytes: int = BLOCK) -> DataFrame:
    """One row per document: tokens, known tokens, the smoothed unigram base score, the tree's log10 probability."""
    spark = prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as many blocks as cores on small tables, where that leaves them half a megabyte
    blocks = max(1, -(-total // block_bytes), min(spark.sparkContext.defaultParallelism, total >> 19))
    parts = 2 * blocks
    rows = asked(docs, blocks, parts)
    N, n_ends = (x or 0 for x in rows.filter("part = -1").agg(F.sum("n_tokens"), F.sum("n_train")).first())
    words = answered_words(rows, parts)
    V = (words.agg(F.sum("n_words")).first()[0] or 0) + (n_ends > 0)  # and the end token
    logs = cut(answered_grams(rows, parts, min_count, min_gain, strength), "logs")
    uncut(rows)  # answered in full
    unit = np.log10(N + 0.5 * (V + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, spelled, answers, known = [], [], {}, {}
        for batch in batches:
            for doc, text, part, packed, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None:
                    ids.append(doc)
                    spelled.append(spell(words_of(text)))
                elif packed is not None:
                    answers[part] = packed
                else:
                    known[part] = c
        if not ids:
            return
        codes, words = tokens_of(spelled)
        end = words.index(END)
        order, at = words_by_part(words, parts)
        order, at = order[order != end], at - (at > np.flatnonzero(order == end)[0])  # END is asked of no part
        counts = np.zeros(len(words), np.int64)
        for p, packed in known.items():
            counts[order[at[p] : at[p + 1]]] = unpack(packed, np.int64)[0]
        counts[end] = n_ends
        known.clear()
        del words, order, at
        n_tokens, n_known, base = score_tokens(codes, end, counts, unit)
        del codes, counts

        def logs_of(keys: np.ndarray) -> np.ndarray:
            order, at = by_part(keys, parts)
            logs = np.full(len(keys), np.nan, np.float32)
            while answers:
                p, packed = answers.popitem()
                logs[order[at[p] : at[p + 1]]] = unpack_logs(packed)
            return logs

        total = tree_scores(spelled, logs_of)
        for k in range(0, len(ids), 4096):
            own = slice(k, k + 4096)
            held = [held_out(x) for x in ids[own]]
            n = np.full(len(held), N, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(held, pa.bool_()), pa.array(n_tokens[own]), pa.array(n_known[own]), pa.array(n), pa.array(base[own]), pa.array(total[own])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # A block's texts and answers in one partition, in any order.
    every = in_blocks(docs, blocks).unionByName(logs, allowMissingColumns=True).unionByName(words.filter("block IS NOT NULL").drop("n_words"), allowMissingColumns=True)
    return every.repartitionById(blocks, "block").select("doc_id", "text", "part", "logs", "counts").mapInArrow(run, SCHEMA)


def score_tokens(codes: np.ndarray, end: int, count: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_tokens, n_known and base score of each text; ``codes`` has the number of each token, ``end`` that of the end token,
    ``count`` the training count of each number; ``unit`` is log10(N + 0.5 (V + 1))."""
    size = np.diff(np.flatnonzero(codes == end), prepend=-1)
    of = np.repeat(np.arange(len(size)), size)
    base = np.bincount(of, (np.log10(count + 0.5) - unit)[codes], len(size))
    return size, np.bincount(of, (count > 0)[codes], len(size)).astype(np.int64), base
