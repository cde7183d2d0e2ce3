"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The best path of a text is the concatenation of the best paths of its units wherever no piece of the vocabulary can
cross the cut; the vocabulary itself proves which cuts are safe (``Pieces.inside``). Units repeat a great deal, so each
distinct unit is decoded once per batch, all of them together, position by position, over the trie's two arrays.
Characters that no piece covers become byte pieces. Decoding joins pieces, turns byte pieces back into bytes (what is
not UTF-8 becomes U+FFFD), white-space markers into blanks, and drops the one blank that encoding put in front.

Edge cases: null and empty texts give no tokens and decode to the empty text; a literal U+2581 in a text decodes to a
blank (as in the library), so that text alone does not come back unchanged; ties go to the path whose last piece starts
earlier; repeated rows and null ids are treated like any other row; extra columns are kept by ``encode_frame``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.common import fresh, prepare, texts

MARK = "▁"
CUT = "\x00"


class DoubleArray:
    """Byte trie in two arrays: child = base[node] ^ (byte + 1) if check[child] == node; value[node] >= 0 marks a key."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 10
        while size < 4 * sum(map(len, keys)) + 1024:
            size *= 2
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        check[0] = 0
        free, todo = 1, [(0, 0, len(order), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            kids: list[tuple[int, int, int]] = []
            i = lo
            while i < hi:
                key = keys[order[i]]
                if len(key) == depth:
                    value[node] = order[i]
                    i += 1
                    continue
                code, j = key[depth] + 1, i
                while j < hi and keys[order[j]][depth] + 1 == code:
                    j += 1
                kids.append((code, i, j))
                i = j
            if not kids:
                continue
            first = kids[0][0]
            while used[free]:
                free += 1
            at = free
            while True:
                if not used[at]:
                    b = at ^ first
                    if all(not used[b ^ c] for c, _, _ in kids):
                        break
                at += 1
            base[node] = b
            for c, i, j in kids:
                used[b ^ c] = 1
                check[b ^ c] = node
                todo.append((b ^ c, i, j, depth + 1))
        top = (int(np.flatnonzero(check >= 0).max()) | 511) + 1
        self.base, self.check, self.value = (np.resize(x[:top], top).copy() for x in (base, check, value))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children by these bytes, -1 where there is none."""
        child = self.base[node] ^ (byte.astype(np.int32) + 1)
        return np.where((child < len(self.check)) & (self.check[np.minimum(child, len(self.check) - 1)] == node), child, -1)


def log_scores(scores: list[float], kinds: list[str]) -> list[float]:
    """Log scores of a model's pieces. A BPE model's scores are merge ranks, whole numbers below zero, whose sums mean nothing;
    they become log probabilities by Zipf's law, 1 / (rank x H), over the normal pieces, equal scores sharing their first
    rank. Other scores are log scores already."""
    normal = np.array([i for i, k in enumerate(kinds) if k == "normal"], np.int64)
    own = np.array(scores, np.float64)
    if not len(normal) or (own[normal] != np.floor(own[normal])).any():
        return scores
    ordered = np.sort(-own[normal])
    rank = np.searchsorted(ordered, -own[normal]) + 1
    own[normal] = -np.log(rank) - np.log((1 / rank).sum())
    return own.tolist()


class Pieces:
    """A vocabulary: pieces, log scores, byte pieces; encodes and decodes. Picklable, a few MB."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], unk_penalty: float = 10.0):
        """kinds: "normal", "byte", "control" or "unknown" for each piece."""
        self.pieces, self.scores = pieces, np.array(scores, np.float64)
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.normal = np.array(normal, np.int32)
        self.trie = DoubleArray([pieces[i].encode() for i in normal])
        self.longest = max((len(pieces[i].encode()) for i in normal), default=1)
        self.byte_id = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        self.unk_score = float(self.scores[self.normal].min() if normal else 0.0) - unk_penalty
        self.inside = {pieces[i][k : k + 2] for i in normal for k in range(len(pieces[i]) - 1)}
        self.newline_alone = not any("\n" in pieces[i] for i in normal)
        self.marks_alone = not any(a != MARK and b == MARK for a, b in self.inside)
        self.surface = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else " ⁇ ".encode() if k == "unknown" else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.is_byte = np.array([k == "byte" for k in kinds])

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "normal"
        kinds = [kind(i) for i in n]
        return cls([sp.id_to_piece(i) for i in n], log_scores([sp.get_score(i) for i in n], kinds), kinds)

    def units(self, text: str) -> list[str]:
        """Parts of the marked text that no piece joins."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not (self.marks_alone and self.newline_alone) or MARK + MARK in marked or CUT in text:
            return self._split(marked)
        return marked.replace(MARK, CUT + MARK).replace("\n", CUT + "\n" + CUT)[1:].split(CUT)

    def _split(self, marked: str) -> list[str]:
        """Cut wherever two neighbours stand together in no piece."""
        cuts = [0, *(k for k in range(1, len(marked)) if marked[k - 1 : k + 1] not in self.inside), len(marked)]
        return [marked[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def solve(self, units: list[str]) -> list[np.ndarray]:
        """Ids of the best path of each unit."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(units)
        where: list[tuple[int, bytes]] = []
        for i, u in enumerate(units):
            b = u.encode()
            if len(b) > 64 and len(parts := self._split(u)) > 1:
                out[i] = np.concatenate(self.solve(parts))
            elif b:
                where.append((i, b))
        where.sort(key=lambda x: len(x[1]))
        k = 0
        while k < len(where):
            width = max(8, 1 << (len(where[k][1]) - 1).bit_length())
            group = [w for w in where[k : k + max(1, (1 << 22) // width)] if len(w[1]) <= width]
            k += len(group)
            for (i, _), ids in zip(group, self._viterbi([b for _, b in group], width), strict=True):
                out[i] = ids
        return out

    def _viterbi(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = len(words)
        size = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(width, b"\x00") for w in words), np.uint8).reshape(n, width)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for p in range(int(size.max())):
            row = np.flatnonzero((size > p) & (best[:, p] > -np.inf))
            if not len(row):
                continue
            lead = text[row, p]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            whole = np.zeros(n, bool)  # the character at p is a piece itself
            width_of = np.zeros(n, np.int32)
            width_of[row] = char
            live, node = row, np.zeros(len(row), np.int32)
            for q in range(p, min(width, p + self.longest)):
                on = size[live] > q
                live, node = live[on], node[on]
                if not len(live):
                    break
                node = self.trie.step(node, text[live, q])
                on = node >= 0
                live, node = live[on], node[on]
                hit = self.trie.value[node]
                on = hit >= 0
                if on.any():
                    r, ids = live[on], self.normal[hit[on]]
                    whole[r[width_of[r] == q + 1 - p]] = True
                    self._relax(best, start, piece, r, p, q + 1, best[r, p] + self.scores[ids], ids)
            for length in (1, 2, 3, 4):
                r = row[(char == length) & ~whole[row]]
                if len(r):
                    r = r[size[r] >= p + length]
                    self._relax(best, start, piece, r, p, p + length, best[r, p] + self.unk_score, np.full(len(r), -2, np.int32))
        out = []
        for w, z, st, pc in zip(words, size.tolist(), start.tolist(), piece.tolist(), strict=True):
            ids: list[int] = []
            while z > 0:
                a = st[z]
                if pc[z] >= 0:
                    ids.append(pc[z])
                else:
                    ids.extend(self.byte_id.get(x, self.unknown) for x in reversed(w[a:z])) if self.byte_id else ids.append(self.unknown)
                z = a
            out.append(np.array(ids[::-1], np.uint32))
        return out

    @staticmethod
    def _relax(best, start, piece, row, p, q, score, ids) -> None:  # noqa: ANN001
        on = score > best[row, q]
        row = row[on]
        best[row, q], start[row, q], piece[row, q] = score[on], p, ids[on]

    def encode(self, text: str, known: dict[str, bytes] | None = None) -> np.ndarray:
        known = {} if known is None else known
        units = self.units(text)
        self.learn(set(units), known)
        return np.frombuffer(b"".join(map(known.__getitem__, units)), np.uint32)

    def learn(self, units: set[str], known: dict[str, bytes], most: int = 1_500_000) -> None:
        """Solve the units not yet known; forget all before the store grows past ``most``."""
        new = sorted(units.difference(known))
        if len(known) + len(new) > most:
            known.clear()
            new = sorted(units)
        known.update(zip(new, (x.tobytes() for x in self.solve(new)), strict=True))

    def decode(self, ids) -> str:  # noqa: ANN001
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def _encoded(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    known: dict[str, bytes] = {}
    for batch in batches:
        whole = texts(batch)
        units = [pieces.units(x) for x in whole]
        pieces.learn({u for us in units for u in us}, known)
        yield batch, whole, [np.frombuffer(b"".join(map(known.__getitem__, us)), np.uint32) for us in units]


def encode_frame(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows with ``token_ids`` (array<int>), ``n_tokens`` and ``decoded`` (the text that the ids give back)."""
    spark = prepare(docs.sparkSession)
    names = [fresh(docs, x) for x in ("token_ids", "n_tokens", "decoded")]
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, _, ids in _encoded(own, batches):
            new = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array([own.decode(x.tolist()) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{_ddl(docs)}, {names[0]} array<int>, {names[1]} bigint, {names[2]} string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def digest(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """One row per document: tokens, byte-fallback tokens, crc32 of the ids (little-endian u32), sha256 of the decoded text, whether it equals the text."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, whole, ids in _encoded(own, batches):
            back = [own.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(own.is_byte[x].sum()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    pa.array([a == b for a, b in zip(whole, back, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")
