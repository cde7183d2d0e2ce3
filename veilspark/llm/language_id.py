"""Language identification with interpolated Kneser-Ney character models.

For each language an n-gram model of characters inside words (``^`` before, ``$`` after) is trained on a bounded sample
of labelled documents: about ``sample_chars`` characters a language, whole documents chosen by hash, one at least. A word
is a run of letters (Unicode category L) of the lower-cased text, in training and prediction alike. N-grams are kept as
64-bit hashes in one sorted array an order, with the interpolated log probability in every language beside each; an
n-gram that no language has seen costs its context's back-off weight and is looked up one order lower. A text gets the
language of the lowest cross-entropy per character. Rejection is calibrated on labelled documents that training
left out (a fifth by hash; a language that has no others is learned from these and not calibrated on): a logistic fit of "the prediction is right" on the margin to the second language and on the length gives
``score``; ``rejected`` marks scores under ``min_score`` and texts whose cross-entropy exceeds what right predictions show.

Edge cases: null texts, and texts without a letter, are ``und`` with score 0; where no labelled document has a letter, all
are ``und``; every language with a letter in some labelled document is learned; with one language known, it is always predicted; ties go to the language that sorts first; very long texts are
read whole; repeated rows and null ids are rows like any other (crc32 of the empty text for a null id).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import crc_mod, prepare, py_crc_mod

LETTERS = regex.compile(r"\p{L}+")
START, END = 1, 2  # code points that stand for the word's edges
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, cross_entropy double, margin double, rejected boolean"


def mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of an n-gram, from its first characters' hash and the next character."""
    with np.errstate(over="ignore"):
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def grid(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, a row each, ended by END and padded by 0; lengths with the end."""
    size = np.array([len(w) + 1 for w in words])
    out = np.zeros((len(words), int(size.max())), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    mask = np.arange(out.shape[1])[None, :] < (size - 1)[:, None]
    out[mask] = flat
    out[np.arange(len(words)), size - 1] = END
    return out, size


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For k = 1..order: hashes of the k-gram that ends at each character (a flat array over all words), and of its first
    k - 1 characters; and the word of each character."""
    g, size = grid(words)
    n, width = g.shape
    padded = np.concatenate([np.full((n, order - 1), START, np.uint64), g], axis=1)
    on = np.arange(width)[None, :] < size[:, None]
    whole, context = [], []
    for k in range(1, order + 1):
        h = np.full((n, width), k, np.uint64)
        for j in range(order - k, order):
            if j == order - 1:
                context.append(h[on])
            h = mix(h, padded[:, j : j + width])
        whole.append(h[on])
    return whole, context, np.repeat(np.arange(n), size)


class KneserNey:
    """Models of all languages over shared sorted hash arrays."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = 5):
        """counts: for each language, its words and how often each occurs."""
        self.langs, self.order = sorted(counts), order
        L = len(self.langs)
        level: list[dict] = [{} for _ in range(order)]
        chars: set[int] = set()
        for i, lang in enumerate(self.langs):
            words = sorted(counts[lang])
            n = np.array([counts[lang][w] for w in words], np.float64)
            whole, context, word = grams(words, order)
            chars.update(map(ord, set("".join(words))))
            for k in range(order, 0, -1):
                key, first, inv = np.unique(whole[k - 1], return_index=True, return_inverse=True)
                if k == order:
                    c = np.bincount(inv, weights=n[word])
                else:  # in how many different left contexts it occurs
                    longer, at = np.unique(whole[k], return_index=True)
                    c = np.bincount(inv[at], minlength=len(key)).astype(np.float64)
                    del longer
                lower = whole[k - 2][first] if k > 1 else None
                level[k - 1][i] = (key, c, context[k - 1][first], lower)
        self.floor = 1.0 / (len(chars) + 2)
        self.keys, self.logp, self.ctx, self.back = [], [], [], []
        below: np.ndarray | None = None
        for k in range(order):
            keys = np.unique(np.concatenate([level[k][i][0] for i in range(L)]))
            ctxs = np.unique(np.concatenate([level[k][i][2] for i in range(L)]))
            prob, back = np.zeros((len(keys), L)), np.ones((len(ctxs), L))
            lower_of = np.zeros(len(keys), np.int64)
            ctx_of = np.zeros(len(keys), np.int64)
            for i in range(L):
                key, c, ctx, lower = level[k][i]
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                at, cx = np.searchsorted(keys, key), np.searchsorted(ctxs, ctx)
                total, kinds = np.bincount(cx, weights=c, minlength=len(ctxs)), np.bincount(cx, minlength=len(ctxs))
                prob[at, i] = np.maximum(c - d, 0) / total[cx]
                seen = total > 0
                back[seen, i] = d * kinds[seen] / total[seen]
                ctx_of[at] = cx
                if k:
                    lower_of[at] = np.searchsorted(self.keys[k - 1], lower)
            prob += back[ctx_of] * (below[lower_of] if k else self.floor)
            below = prob
            self.keys.append(keys)
            self.logp.append(np.log(prob))
            self.ctx.append(ctxs)
            self.back.append(np.log(back))

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and its characters with the end."""
        whole, context, word = grams(words, self.order)
        total = np.zeros((len(word), len(self.langs)))
        todo = np.arange(len(word))
        for k in range(self.order - 1, -1, -1):
            at, hit = _find(self.keys[k], whole[k][todo])
            total[todo[hit]] += self.logp[k][at[hit]]
            todo = todo[~hit]
            cx, known = _find(self.ctx[k], context[k][todo])
            total[todo[known]] += self.back[k][cx[known]]
            if not len(todo):
                break
        total[todo] += np.log(self.floor)
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, word, total) if len(words) < 2 else out.__iadd__(np.stack([np.bincount(word, weights=total[:, i], minlength=len(words)) for i in range(len(self.langs))], axis=1))
        return out, np.bincount(word, minlength=len(words))


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return at, keys[at] == x


class Judge:
    """Cross-entropies of whole texts; each distinct word is scored once for many texts."""

    def __init__(self, model: KneserNey, most: int = 1_500_000):
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.value, self.size = np.zeros((1 << 12, len(self.model.langs))), np.zeros(1 << 12, np.int64)

    def _learn(self, new: list[str]) -> None:
        parts = [LETTERS.findall(w) for w in new]
        flat = sorted({p for ps in parts for p in ps})
        score, n = np.zeros((0, len(self.model.langs))), np.zeros(0, np.int64)
        if flat:
            done = [self.model.score(group) for group in _groups(flat)]
            score, n = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = {p: i for i, p in enumerate(x for g in _groups(flat) for x in g)}
        base, need = len(self.place), len(self.place) + len(new)
        while need > len(self.size):
            self.value, self.size = np.concatenate([self.value, np.zeros_like(self.value)]), np.concatenate([self.size, np.zeros_like(self.size)])
        owner = np.repeat(np.arange(len(new)), [len(ps) for ps in parts])
        at = np.fromiter((order[p] for ps in parts for p in ps), np.int64, len(owner))
        for i in range(len(self.model.langs)):
            self.value[base:need, i] = np.bincount(owner, weights=score[at, i], minlength=len(new)) if len(at) else 0
        self.size[base:need] = np.bincount(owner, weights=n[at], minlength=len(new)) if len(at) else 0
        self.place.update((w, base + i) for i, w in enumerate(new))

    def texts(self, xs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language (nats a character), and its characters in words."""
        words = [(x or "").lower().split() for x in xs]
        new = {w for ws in words for w in ws}.difference(self.place)
        if len(self.place) + len(new) > self.most:
            self.forget()
            new = {w for ws in words for w in ws}
        self._learn(sorted(new))
        ce, n = np.zeros((len(xs), len(self.model.langs))), np.zeros(len(xs), np.int64)
        for i, ws in enumerate(words):
            if ws:
                at = np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))
                n[i] = self.size[at].sum()
                ce[i] = -self.value[at].sum(axis=0) / max(1, n[i])
        return ce, n


def _groups(words: list[str]) -> list[list[str]]:
    """The words by length, in groups whose grids stay small."""
    words = sorted(words, key=len)
    out, k = [], 0
    while k < len(words):
        width = max(16, 2 * len(words[k]))
        end = k
        while end < len(words) and len(words[end]) <= width and (end - k) * width < 1 << 21:
            end += 1
        out.append(words[k:end])
        k = end
    return out


class Calibration:
    """P(right | margin, characters) by logistic regression, and the highest cross-entropy to accept."""

    def __init__(self, margin: np.ndarray, n: np.ndarray, right: np.ndarray, ce: np.ndarray):
        x = self.features(margin, n)
        # Laplace-like pseudo observations keep the fit finite where all predictions are right.
        x = np.concatenate([x, [[1.0, 0.0], [1.0, 0.0], [1.0, 3.0]]])
        y = np.concatenate([right.astype(float), [1.0, 0.0, 1.0]])
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            w += np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
        self.w = np.array([w[0], max(w[1], 0.0)])
        good = ce[right]
        self.most = float(np.quantile(good, 0.999) + 1.0) if len(good) >= 20 else float("inf")

    @staticmethod
    def features(margin: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(margin)), margin * np.sqrt(np.minimum(n, 400))], axis=1)

    def score(self, margin: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(margin, n) @ self.w, -30, 30)))


def _best(ce: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = ce.argmin(axis=1)
    low = ce[np.arange(len(ce)), best]
    if ce.shape[1] == 1:
        return best, low, np.full(len(ce), 1.0)
    return best, low, np.partition(ce, 1, axis=1)[:, 1] - low


def word_counts(sample: DataFrame) -> DataFrame:
    """lang, word, n: words of the documents (columns lang and text), cut as predictions cut them."""
    prepare(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, k in Counter(text.lower().split()).items():
                    for part in LETTERS.findall(w):
                        n[lang, part] += k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    each = sample.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, word string, n bigint")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, order: int = 5, sample_chars: int = 1_500_000, calibration_docs: int = 1000) -> tuple[KneserNey, Calibration] | None:
    """Fit on documents whose crc32(doc_id) mod 5 is 2, 3 or 4, calibrate on those with 1 (a language that has only these is
    learned from them). About ``sample_chars`` characters a language, its document of lowest hash at least, and
    ``calibration_docs`` documents are used, chosen by hash; None where no labelled document has a letter."""
    u = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", crc_mod(F.col("doc_id"), 5).alias("fold"), u.alias("u")).filter("fold <> 0")
    of = lambda on, x: F.when(on, x)
    late, early = F.col("fold") == 1, F.col("fold") > 1
    sizes = labelled.groupBy("lang").agg(*(f(of(on, x)).alias(k + n) for on, n in ((early, "2"), (late, "1")) for f, x, k in ((F.sum, F.length("text"), "chars"), (F.min, F.col("u"), "least"), (F.count, F.lit(1), "n")))).collect()  # a row for each language
    if not sizes:
        return None
    fold = {r["lang"]: "2" if r["n2"] else "1" for r in sizes}
    limit = {r["lang"]: max(sample_chars / max(1, r["chars" + fold[r["lang"]]]), r["least" + fold[r["lang"]]]) for r in sizes}
    table = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col("lang")]
    sample = labelled.filter((F.when(early, "2").otherwise("1") == table(fold)) & (F.col("u") <= table(limit)))
    counts: dict[str, Counter] = {}
    for lang, word, n in word_counts(sample).collect():
        counts.setdefault(lang, Counter())[word] += n
    if not counts:
        return None
    model = KneserNey(counts, order)
    every = sum(r["n1"] for r in sizes if fold[r["lang"]] == "2")
    held = labelled.filter(late & (table(fold) == "2") & (F.col("u") < calibration_docs / max(1, every))).select(F.col("lang").cast("string").alias("lang"), "text")
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            ce, n = judge.texts(batch.column(1).to_pylist())
            best, low, margin = _best(ce)
            right = [judge.model.langs[b] == x for b, x in zip(best, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(margin), pa.array(n), pa.array(right, pa.bool_()), pa.array(low)], names=["margin", "n", "right", "ce"])

    got = [r for r in held.mapInArrow(run, "margin double, n bigint, right boolean, ce double").collect() if r["n"]]
    return model, Calibration(*(np.array([r[k] for r in got], t) for k, t in (("margin", float), ("n", float), ("right", bool), ("ce", float))))


def predict(docs: DataFrame, fitted: tuple[KneserNey, Calibration] | None, min_score: float = 0.5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, margin, rejected, from the texts alone."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        judge = Judge(own[0]) if own else None
        for batch in batches:
            ids, xs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if own:
                ce, n = judge.texts(xs)
                best, low, margin = _best(ce)
                score = own[1].score(margin, n)
                lang = [own[0].langs[b] if k else "und" for b, k in zip(best, n, strict=True)]
                off = (n == 0) | (score < min_score) | (low > own[1].most)
                score, low, margin = np.where(n > 0, score, 0.0), np.where(n > 0, low, 0.0), np.where(n > 0, margin, 0.0)
            else:
                score = low = margin = np.zeros(len(ids))
                lang, off = ["und"] * len(ids), np.ones(len(ids), bool)
            held = [py_crc_mod(x, 5) == 0 for x in ids]
            cols = [pa.array(held, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(margin, pa.float64()), pa.array(off, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "margin", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
