"""Token counts by overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a boundary in their overlap that is *proven stable*: the two characters beside it never stand next to
each other inside any piece of the vocabulary, so no merge can cross it, whatever stands further away. Both
encodings must show a token boundary there; where the overlap has none, it is doubled and encoded again, at last
up to the whole text.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are counted like any other;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.common import prepare, texts

MARK = "▁"
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint, n_widened bigint"


class PieceCounter:
    """Counts tokens of a sentencepiece model. Needs a model that leaves its input as it is (identity normaliser)."""

    def __init__(self, path: str, chunk_chars: int = 32768, overlap: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk_chars, overlap
        self.inside: set[str] = set()
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)):
                piece = self.sp.id_to_piece(i).replace(MARK, " ")
                self.inside.update(piece[k : k + 2] for k in range(len(piece) - 1))
        # Chunks give whole-text tokens only if white space and letters come through unchanged.
        self.exact = self.sp.decode(self.sp.encode(" a  b\nCＡ ")) == " a  b\nCＡ " and self.sp.id_to_piece(3).startswith("<0x")

    def stable(self, text: str, p: int) -> bool:
        return 0 < p < len(text) and text[p - 1 : p + 1].replace(MARK, " ") not in self.inside

    def begins(self, text: str, start: int, stop: int) -> list[int]:
        """Where the tokens of text[start:stop] begin, as positions in text; the byte pieces of a character all begin at it."""
        return [start + a for a, _ in self.sp.encode(text[start:stop], return_type="offset_mapping")["offsets"]]

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, chunks, widened overlaps."""
        if len(text) <= self.chunk or not self.exact:
            return len(self.sp.encode(text)), 1, 0
        total, chunks, widened = 0, 1, 0
        start, stop = 0, self.chunk
        left, since = self.begins(text, start, stop), 0  # tokens of left from since on are still to be counted
        while stop < len(text):
            overlap = self.overlap
            while True:
                nxt = max(since, stop - overlap)
                after = min(len(text), nxt + self.chunk + overlap)
                right = self.begins(text, nxt, after)
                cut_at = self._splice(text, nxt, stop, left, right)
                if cut_at is not None:
                    break
                widened += 1
                overlap *= 2
                if overlap > 2 * len(text):
                    return len(self.sp.encode(text)), 1, widened
                if nxt == since:  # no stable boundary in the whole chunk: lengthen it
                    stop = min(len(text), stop + self.chunk)
                    left = self.begins(text, start, stop)
                    if stop == len(text):
                        break
            if cut_at is None:
                break
            total += sum(since <= b < cut_at for b in left)
            start, stop, left, since = nxt, after, right, cut_at
            chunks += 1
        return total + sum(b >= since for b in left), chunks, widened

    def _splice(self, text: str, lo: int, hi: int, left: list[int], right: list[int]) -> int | None:
        common = set(left) & set(right)
        return next((p for p in sorted(common) if lo < p < hi and self.stable(text, p)), None)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk_chars: int = 32768, overlap: int = 256) -> DataFrame:
    """One row per document: bytes, tokens, whether the tokens exceed ``limit``, chunks and widened overlaps."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path, chunk_chars, overlap)
        for batch in batches:
            whole = texts(batch)
            short = [i for i, x in enumerate(whole) if len(x) <= chunk_chars]
            got: list = [None] * len(whole)
            for i, ids in zip(short, counter.sp.encode([whole[i] for i in short], num_threads=1), strict=True):
                got[i] = (len(ids), 1, 0)
            got = [g or counter.count(x) for g, x in zip(got, whole, strict=True)]
            n = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x.encode()) for x in whole], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                    pa.array([g[1] for g in got], pa.int64()),
                    pa.array([g[2] for g in got], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
