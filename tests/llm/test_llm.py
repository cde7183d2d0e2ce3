"""The corpus operators against brute force, the libraries, round trips and held-out documents; edge cases of each."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, host_rules, id_blocks, language_id, line_dedup, near_dups, suffix_tree_lm, token_counts, unigram, warc
from veilspark.llm.queries import pieces, tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in is that for with as river stone cloud paper green light house bread winter music letter garden".split()
EDGES = [None, "", " ", "\n", "\t \r\n", "a", "A b", "x\n\nx\n x ", "  two  blanks  ", "日本語 テスト 🎉", "a<|endoftext|>b", "▁mark ▁▁", "nul\x00byte", "\x1c odd \x1d", "é" * 50]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ".", ",", "ly", "er"]) for _ in range(n))


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    out = [prose(rnd, rnd.randint(5, 200)) for _ in range(n)]
    base = prose(rnd, 120)
    for k in range(20):  # near copies, a few words changed
        w = base.split()
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS) + "x"
        out.append(" ".join(w))
    out += [base] * 5 + [base.upper()] + [prose(rnd, 3) + "\nshared line of words\n" + prose(rnd, 3) for _ in range(12)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus() + EDGES
    rows = [(i, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", "en", "s1", 10)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# --- 1 decontamination ---


def edit_distance_to_substring(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, e in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (c != e), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_decontamination_finds_all_within_budget():
    rnd = random.Random(5)
    items = [(k, prose(rnd, n)) for k, n in enumerate([3, 8, 15, 30])] + [(9, "tiny"), (10, None), (11, "")]
    own = decontaminate.Items([(i, t) for i, t in items if t], 0.08)
    for _ in range(80):
        n = rnd.randrange(4)
        x = list(items[n][1])
        for _ in range(rnd.randint(0, int(own.k[n]) + 3)):
            p = rnd.randrange(len(x))
            x[p : p + rnd.randint(0, 1)] = rnd.choice(["", "q", "zz"])
        text = prose(rnd, 20) + " " + "".join(x) + "\n" + prose(rnd, 20)
        got = {g[1]: g[2] for g in own.match([decontaminate.normal(text)])}
        for m, (_, t) in enumerate(items[:4]):
            d = edit_distance_to_substring(t.lower(), text.lower().replace("\n", " "))
            assert (m in got) == (d <= own.k[m])
            if m in got:
                assert got[m] == d


def test_decontamination_windows_and_frames(spark, docs, empty, monkeypatch):
    rnd = random.Random(8)
    item = prose(rnd, 25)
    bench = spark.createDataFrame([(1, item), (2, None), (3, item)], "item_id bigint, text string")
    long = prose(rnd, 4000) + " " + item.upper().replace(" ", "\n") + " " + prose(rnd, 4000)
    monkeypatch.setattr(decontaminate, "WINDOW", 4096)
    own = decontaminate.Items([(1, item)], 0.08)
    (hit,) = own.match([decontaminate.normal(long)])
    assert long[hit[3] : hit[4]].lower().replace("\n", " ") == item.lower()
    extra = docs.unionByName(spark.createDataFrame([(900, long, "en", "s", 1)], SCHEMA)).withColumn("Item_id", F.lit(5))
    got = decontaminate.contaminated(extra, bench, block_chars=200).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(900, 1), (900, 3)}
    kept = decontaminate.clean(extra, bench)
    assert kept.columns == extra.columns and kept.count() == docs.count()
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench.filter("item_id = 2")).count() == docs.count()


def test_decontamination_items_longer_than_half_a_window(monkeypatch):
    rnd = random.Random(9)
    item, short = prose(rnd, 110), "a short item of another kind"
    own = decontaminate.Items([(1, item), (2, short)], 0.08)
    before = prose(rnd, 500)
    long = before + " " + item + " " + prose(rnd, 500) + " " + short
    for window in (own.reach // 2, own.reach, 2 * own.reach - 8, 2 * own.reach, 2 * own.reach + 8):
        monkeypatch.setattr(decontaminate, "WINDOW", window)
        got = own.match([decontaminate.normal(long)])
        assert [g[1:3] for g in got] == [(0, 0), (1, 0)] and got[0][3] == len(before) + 1


# --- 2 token counts ---


def test_token_counts_equal_library(spark, docs, empty):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = token_counts.count_tokens(docs, path, limit=20, chunk_chars=64, overlap=4).collect()
    want = sorted(((i is None, i or 0), len(t.encode()), len(sp.encode(t))) for i, t in rows_of(docs))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for r in out)
    assert max(r["n_chunks"] for r in out) > 3
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_counts_widen_and_give_up():
    own = token_counts.PieceCounter(tokenizer("piece_bpe_32k.model"), 50, 2)
    for text in ["a" * 700, " " * 300, "=" * 333 + " x " * 60, "日本" * 90 + "b" * 120, "the " * 100 + "\n" * 100]:
        assert own.count(text)[0] == len(own.sp.encode(text))
    assert any(own.count(t)[2] for t in ["a" * 700, "=" * 333])


# --- 3 sentencepiece unigram ---


def best_path(own, marked):
    best = [(-math.inf, 0, None)] * (len(marked) + 1)
    best[0] = (0.0, 0, None)
    by = {own.pieces[i]: i for i in own.normal.tolist()}
    for p in range(len(marked)):
        if best[p][0] == -math.inf:
            continue
        for q in range(p + 1, min(len(marked), p + 20) + 1):
            i = by.get(marked[p:q])
            if i is not None and best[p][0] + own.scores[i] > best[q][0]:
                best[q] = (best[p][0] + own.scores[i], p, i)
        if marked[p] not in by and best[p][0] + own.unk_score > best[p + 1][0]:
            best[p + 1] = (best[p][0] + own.unk_score, p, None)
    ids, q = [], len(marked)
    while q:
        _, p, i = best[q]
        ids[:0] = [i] if i is not None else [own.byte_id[b] for b in marked[p:q].encode()]
        q = p
    return ids


def test_unigram_equals_plain_viterbi_and_decodes():
    own, rnd = pieces(), random.Random(3)
    texts = [t for t in EDGES if t] + corpus(7, 20) + ["".join(rnd.choice("ab thein.é\n🎉 ") for _ in range(rnd.randint(1, 70))) for _ in range(200)] + ["x" * 300, "ab" * 90]
    known = {}
    for t in texts:
        ids = own.encode(t, known).tolist()
        assert ids == best_path(own, unigram.MARK + t.replace(" ", unigram.MARK))
        assert own.decode(ids) == t.replace(unigram.MARK, " ")
    assert own.encode("").tolist() == [] and own.decode([]) == ""


def test_unigram_scores_are_log_scores_not_ranks():
    import sentencepiece

    own, sp = pieces(), sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    assert np.exp(own.scores[own.normal]).sum() == pytest.approx(1)
    text = "the government of the people and the history of music in the summer garden"
    assert len(own.encode(text)) <= 1.2 * len(sp.encode(text))
    assert any(own.pieces[i].startswith("▁▁") for i in own.encode("many" + " " * 9 + "blanks"))
    given = [-1.5, -2.25, 0.0]
    assert unigram.log_scores(given, ["normal", "normal", "control"]) == given


def test_double_array_holds_its_keys():
    keys = [p.encode() for p in ["a", "ab", "abc", "b", "é", "日本", "zz"]]
    trie = unigram.DoubleArray(keys)

    def find(k):
        node = np.zeros(1, np.int32)
        for b in k:
            node = trie.step(node, np.array([b]))
            if node[0] < 0:
                return -1
        return int(trie.value[node[0]])

    assert [find(k) for k in keys] == list(range(len(keys))) and find(b"ac") == -1 and find(b"z") == -1


def test_unigram_frames(docs, empty):
    out = unigram.digest(docs, pieces()).collect()
    by = Counter((r["doc_id"], r["decoded_sha256"]) for r in out)
    assert by == Counter((i, sha256(t.replace(unigram.MARK, " ").encode()).hexdigest()) for i, t in rows_of(docs))
    wide = docs.withColumn("Token_ids", F.lit(1))
    enc = unigram.encode_frame(wide, pieces())
    assert enc.columns[: len(wide.columns)] == wide.columns and enc.columns[-3] == "token_ids_" and enc.count() == docs.count()
    assert unigram.digest(empty, pieces()).count() == 0


# --- 4 suffix tree ---


def test_suffix_tree_scores(docs, empty, spark):
    out = suffix_tree_lm.score(docs, block_bytes=20_000).collect()
    all_rows = rows_of(docs)
    train = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for i, t in all_rows if not suffix_tree_lm.held_out(i)]
    c = Counter(w for ws in train for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in all_rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)) + [None]
        want[i] = (len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    assert len(out) == len(all_rows)
    for r in out:
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2] and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2])
        assert r["score"] <= 0 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 if r["doc_id"] is not None else False)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert suffix_tree_lm.score(empty).count() == 0
    one = suffix_tree_lm.score(spark.createDataFrame([(5, "only held out words", "en", "s", 1)], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["n_tokens"] == 5
    none = suffix_tree_lm.score(spark.createDataFrame([(i, "a b", "en", "s", 1) for i in range(400) if suffix_tree_lm.held_out(i)], SCHEMA)).collect()
    assert none and all((r["n_known"], r["train_tokens"]) == (0, 0) and r["score"] == pytest.approx(5 * math.log10(1 / 256), abs=0.01) for r in none)
    same = suffix_tree_lm.score(docs, block_bytes=3000)
    assert {(r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in same.collect()} == {(r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in out}


def plain_suffix_tree(train, min_count, min_gain, strength):
    """Probability of a byte after a context of up to DEPTH bytes, over counts of the whole corpus in one dict."""
    n, total = Counter(), Counter()
    for t in train:
        s = suffix_tree_lm.PAD + t
        for i in range(suffix_tree_lm.DEPTH, len(s)):
            for k in range(suffix_tree_lm.DEPTH + 1):
                n[s[i - k : i], s[i]] += 1
                total[s[i - k : i]] += 1

    def p(ctx, sym):
        return (n[ctx, sym] + strength * (p(ctx[1:], sym) if ctx else 1 / 256)) / (total[ctx] + strength)

    keep = {b""} | {c for c in total if len(c) <= suffix_tree_lm.LOW}
    for c in total:
        if len(c) > suffix_tree_lm.LOW and total[c] >= min_count:
            if total[c] * sum(p(c, x) * math.log(p(c, x) / p(c[1:], x)) for x in range(256)) >= min_gain:
                keep |= {c[j:] for j in range(len(c))}
    return lambda ctx, sym: p(next(c for j in range(len(ctx) + 1) if (c := ctx[j:]) in keep), sym), keep


def test_suffix_tree_in_parts_equals_plain_tree(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(WORDS[10:15]) for _ in range(rnd.randint(0, 30))), "en", "s", 1) for i in range(60)]
    out = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), min_gain=1.0, block_bytes=1000).collect()}
    spelled = {r[0]: suffix_tree_lm.spell(suffix_tree_lm.words_of(r[1].encode())) for r in rows}
    prob, keep = plain_suffix_tree([t for i, t in spelled.items() if not suffix_tree_lm.held_out(i)], 2, 1.0, 4.0)
    assert max(map(len, keep)) > 3
    for i, t in spelled.items():
        s = suffix_tree_lm.PAD + t
        assert out[i] == pytest.approx(sum(math.log10(prob(s[j - suffix_tree_lm.DEPTH : j], s[j])) for j in range(suffix_tree_lm.DEPTH, len(s))), abs=len(s) / suffix_tree_lm.STEP / 2 + 1e-4)


def test_lm_texts_as_arrays():
    """Tokens, their order by part and sums of log probabilities, without an object for a token or a sort by an index."""
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    words = [b"plumless", b"a", b"buckeroo", b"\xc3\xa9", b"z"]
    spelled = [suffix_tree_lm.spell(x) for x in (words, [], [b"a", b"a", b"z"])]
    codes, distinct = suffix_tree_lm.tokens_of(spelled)
    assert [distinct[k] for k in codes.tolist()] == [*words, b"", b"", b"a", b"a", b"z", b""]
    n_tokens, n_known, base = suffix_tree_lm.score_tokens(codes, distinct.index(b""), np.array([w != b"a" for w in distinct]).astype(int), 1.0)
    assert n_tokens.tolist() == [6, 1, 4] and n_known.tolist() == [5, 1, 2] and base[2] == pytest.approx(2 * math.log10(0.5) + 2 * math.log10(1.5) - 4)
    for parts in (1, 3):
        seen = {tuple(tuple(x[k] for k in order[a:b]) for a, b in zip(at, at[1:], strict=False)) for x in (words, words[::-1]) for order, at in [suffix_tree_lm.words_by_part(x, parts)]}
        assert len(seen) == 1 and [{zlib.crc32(w) % parts for w in ws} or {p} for p, ws in enumerate(*seen)] == [{p} for p in range(parts)]
    logs = lambda keys: -(keys % np.uint64(1009)).astype(np.float32) / 256
    narrow = [*spelled, *(suffix_tree_lm.spell([bytes([97 + k % 26, 97 + k % 7])] * (k % 40)) for k in range(500))]
    for texts in (narrow, [*narrow, bytes(x for x in range(256) if x not in b" \n") + b" \n"]):  # few values of bytes, and all
        assert suffix_tree_lm.tree_scores(texts, logs).tolist() == [pytest.approx(float(logs(suffix_tree_lm.keys_of([x])).astype(float).sum())) for x in texts]
        assert (suffix_tree_lm.all_keys(texts) == suffix_tree_lm.keys_of(texts)).all()


def test_suffix_tree_keeps_contexts_whatever_the_size_of_the_corpus():
    """Contexts seen 600 times answer the same when the rest of the corpus is a million times larger (a share of all positions cut them)."""
    key = lambda t: suffix_tree_lm.keys_of([t])[-2:-1]  # noqa: E731  (the byte before the end)
    keys, n = suffix_tree_lm.merged([(key(b"zqzqzq" + x + b"\n"), np.array([300])) for x in (b"a", b"b")])
    few = None
    for size in (10**6, 10**12):
        noise = suffix_tree_lm.keys_of([b"the of and to \n"])
        low = suffix_tree_lm.LowLevels(*suffix_tree_lm.merged([suffix_tree_lm.low_grams(keys, n), *(suffix_tree_lm.low_grams(noise[i : i + 1], np.array([size])) for i in range(len(noise)))]))
        p = 10.0 ** suffix_tree_lm.solve(keys, n, low, 2, 12.0, 4.0).astype(float)
        assert (p > 0.45).all() and (few is None or np.allclose(p, few))
        few = p


# --- 5 language ---

LANGS = {"aa": "thetheonandinger", "bb": "derdiedasundichsch", "cc": "lequelesoiionaux"}


def _speak(rnd, lang, n):
    s = LANGS[lang]
    return " ".join("".join(s[k : k + 3] for k in (rnd.randrange(len(s) - 3) for _ in range(rnd.randint(1, 4)))) for _ in range(n))


def test_language_accuracy_and_edges(spark, empty):
    rnd = random.Random(4)
    rows = [(i, _speak(rnd, lang, 40), lang, "s", 1) for i in range(300) for lang in [rnd.choice(list(LANGS))]]
    extra = [(1000, None, "aa", "s", 0), (1001, "123 ?!", "aa", "s", 0), (1002, "", None, "s", 0), (None, _speak(rnd, "bb", 30), "bb", "s", 0)]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    out = {r["doc_id"]: r for r in language_id.predict(df, language_id.train(df)).collect()}
    held = [r for r in rows if out[r[0]]["held_out"]]
    assert len(held) > 20 and all(out[r[0]]["lang_pred"] == r[2] for r in held)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert [out[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and out[1000]["rejected"]
    assert language_id.train(empty) is None and language_id.predict(df, None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty, None).count() == 0


def test_language_is_und_without_a_letter(spark):
    rows = [(i, prose(random.Random(i), 30), "en", "s", 1) for i in range(30)] + [(100 + i, t, None, "s", 1) for i, t in enumerate(["½ ² 10", "٣ Ⅳ _", "", None, "…", "ⅷ²", "a½"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert [got[100 + i] for i in range(7)] == [("und", False)] * 6 + [("en", True)]


def test_every_labelled_language_is_learned(spark):
    """A language in one long document, one found in the calibration fold alone, one in the same fold that is never learned from."""
    fold = lambda k, n: [i for i in range(1, 5000) if zlib.crc32(str(i).encode()) % 5 == k][:n]
    rows = [(i, "the house of green light " * 9, "aa", "s", 1) for i in fold(3, 40)]
    rows += [(fold(2, 1)[0], "zwischen jkjk qwqw " * 3000, "bb", "s", 1), (fold(1, 1)[0], "vvuu ooii vvoo " * 20, "cc", "s", 1), (fold(0, 1)[0], "xyxy", "dd", "s", 1)]
    rows += [(fold(4, 1)[0], "12 ½", "ee", "s", 1)]
    model, _ = language_id.train(spark.createDataFrame(rows, SCHEMA), sample_chars=500)
    assert model.langs == ["aa", "bb", "cc"]
    alone = spark.createDataFrame([rows[41], (fold(0, 2)[1], "vvuu vvoo", None, "s", 1)], SCHEMA)
    assert [r["lang_pred"] for r in language_id.predict(alone, language_id.train(alone)).collect()] == ["cc", "cc"]


def plain_kneser_ney(counts, order, floor):
    """Interpolated Kneser-Ney over dicts of tuples: log probability of a word and its end."""
    spell = lambda w: [1] * (order - 1) + [ord(c) for c in w] + [2]
    top = Counter()
    for w, n in counts.items():
        s = spell(w)
        for i in range(order - 1, len(s)):
            top[tuple(s[i - order + 1 : i + 1])] += n
    level = {order: top}
    grams = {order: set(top)}
    for k in range(order - 1, 0, -1):
        grams[k] = {g[1:] for g in grams[k + 1]}
        level[k] = Counter(g[1:] for g in grams[k + 1])
    d, total, kinds = {}, {}, {}
    for k, c in level.items():
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total[k], kinds[k] = Counter(), Counter()
        for g, x in c.items():
            total[k][g[:-1]] += x
            kinds[k][g[:-1]] += 1

    def p(g):
        if not g:
            return floor
        k, low = len(g), p(g[1:])
        t = total[k][g[:-1]]
        return low if not t else (max(level[k][g] - d[k], 0) + d[k] * kinds[k][g[:-1]] * low) / t

    return lambda w: sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for s in [spell(w)] for i in range(order - 1, len(s)))


def test_kneser_ney_equals_plain_recursion():
    rnd = random.Random(12)
    word = lambda chars: "".join(rnd.choice(chars) for _ in range(rnd.randint(1, 6)))
    counts = {"x": Counter(word("abcd") for _ in range(80)), "y": Counter(word("bcde") for _ in range(50)), "z": Counter({"zz": 3})}
    model = language_id.KneserNey(counts, 4)
    words = sorted({word("abcdefz") for _ in range(150)})
    got, n = model.score(words)
    floor = 1 / (len(set("".join(w for c in counts.values() for w in c))) + 2)
    for i, lang in enumerate(model.langs):
        plain = plain_kneser_ney(counts[lang], 4, floor)
        assert np.allclose(got[:, i], [plain(w) for w in words])
    assert n.tolist() == [len(w) + 1 for w in words]


def test_kneser_ney_sums_to_one():
    m = language_id.KneserNey({"x": Counter({"aab": 3, "ab": 2, "b": 1}), "y": Counter({"ba": 2, "c": 1})}, 3)
    chars = "abc"
    for context in ("", "a", "ab", "zz"):
        total = np.zeros(2)
        for c in chars:
            total += np.exp(m.score([context + c])[0][0] - m.score([context])[0][0] + _end(m, context) - _end(m, context + c))
        total += np.exp(_end(m, context))
        assert (total <= 1 + 1e-9).all() and (total > 0.5).all()


def _end(m, word):
    """Log probability of the word's end after it."""
    whole, context, _ = language_id.grams([word], m.order)
    out = np.zeros(len(m.langs))
    for k in range(m.order - 1, -1, -1):
        at, hit = language_id._find(m.keys[k], whole[k][-1:])
        if hit[0]:
            return out + m.logp[k][at[0]]
        cx, known = language_id._find(m.ctx[k], context[k][-1:])
        if known[0]:
            out = out + m.back[k][cx[0]]
    return out + np.log(m.floor)


# --- 6 rules ---


def plain_measure(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {q for i in range(len(ws) - 2) if win[tuple(ws[i : i + 3])] > 1 for q in (i, i + 1, i + 2)}
    return len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in t), dup, len(hit)


def test_rules_measures_and_hosts(spark, docs, empty):
    for t in [*(x or "" for x in EDGES), *corpus(9, 30), "a b c a b c a b c", "x y z\nx y z\n#*$", "a a a a a a"]:
        assert host_rules.measure(t) == plain_measure(t)
    out = host_rules.assess(docs).collect()
    assert len(out) == docs.count() and all(not (r["kept"] and r["base_failed"]) for r in out)
    rnd = random.Random(6)
    good = [(i, " ".join(f"w{rnd.randrange(999)}" for _ in range(80)), "en", f"g{i % 4}", 1) for i in range(80)]
    bad = [(100 + i, "too short" if i else " ".join(f"w{rnd.randrange(999)}" for _ in range(80)), "en", "bad", 1) for i in range(40)]
    df = spark.createDataFrame(good + bad, SCHEMA).withColumn("Rule_x", F.lit(1))
    kept = {r["doc_id"]: r["kept"] for r in host_rules.assess(df).collect()}
    assert all(kept[r[0]] for r in good) and not any(kept[r[0]] for r in bad)
    out = host_rules.keep_good(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {r[0] for r in good}
    assert host_rules.assess(empty).count() == 0 and host_rules.keep_good(empty).count() == 0


# --- 7 token ids ---


def test_ids_come_back(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    out = id_blocks.store_and_read(docs, path, 2).collect()
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows_of(docs) for ids in [tok.encode(t, add_special_tokens=False).ids + [2]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    rows = sorted(out, key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert id_blocks.store_and_read(empty, path).count() == 0


def test_byte_words_are_kept_once():
    """A word with and without a mark after it is one entry of the store; all texts get the library's ids."""
    own = id_blocks.ByteEncoder(tokenizer("byte_bpe_50k.json"))
    texts = ["ab cd, cd. cd; \u00e9t\u00e9: cd", "ab.", None, "", "cd..", " \u00aa, \u0250. x\u00d7y; \u01c0", "a\x0b. b\x85, c\x00d.", "2, 3. \u65e5; \u200b."]
    for _ in range(2):
        assert own.encode(texts) == own.whole([x or "" for x in texts])
        assert [w for w in own.parts if "cd" in w] == [" cd", "cd.."]
    rnd = random.Random(3)
    letters = [*"ab Z\u00e9\u00df\u024f\u0250\u00b5\u00d7.,;:!'\n\t\x0b\x85\u3000\u0436\u0663 9-\u0301", *[" "] * 8, "the", " <|endoftext|>"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    assert own.encode(texts) == own.whole(texts)


def test_byte_encoder_equals_library():
    rnd = random.Random(1)
    own = id_blocks.ByteEncoder(tokenizer("byte_bpe_50k.json"), most=100_000)
    texts = [t or "" for t in EDGES] + corpus(3, 30) + ["".join(rnd.choice("ab 1é\n🎉'st\t .\x1c\x85　​ ") for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for k in range(0, len(texts), 97):
        assert own.encode(texts[k : k + 97]) == own.whole(texts[k : k + 97])


def test_block_reads_one_document():
    rnd = np.random.default_rng(1)
    docs = [(i * 3 if i else None, rnd.integers(0, 50000, n).astype("<u4").tobytes()) for i, n in enumerate([1, 5, 0, 900])]
    for d in (b"", bytes(range(200)) * 4):
        block = id_blocks.Block(id_blocks.write_block(docs, 77, d), d)
        assert block.before == 77 and block.find(9).tobytes() == docs[3][1] and block.find(4) is None and block.find(0) is None
        with pytest.raises(ValueError):
            id_blocks.Block(id_blocks.write_block(docs, 0, d), d + b"x")


def test_shared_dictionary_is_trained_and_used(spark):
    """A corpus large enough to train on: the blocks are written and read with the trained dictionary, and are smaller for it."""
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    words = [w + x for w in WORDS for x in ("", "s", "ing", "ed", "ness")]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(60)) + ". All rights reserved by the house of letters." * (i % 2), "en", "s", 1) for i in range(900)], SCHEMA)
    path = tokenizer("byte_bpe_50k.json")
    d = id_blocks.train_dictionary(docs, path, 2)
    assert d[:4] == bytes.fromhex("37a430ec")  # the magic number of a trained dictionary
    blocks = id_blocks.write_ids(docs, path, d, 2, 3)
    tok = Tokenizer.from_file(path)
    want = {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids + [2] for r in docs.collect()}
    got, size = {}, 0
    for r in blocks.collect():
        block = id_blocks.Block(r["block"], d)
        size += len(block.body)
        got |= {int(block.index["doc_id"][k]): np.frombuffer(block.ids(k), np.uint32).tolist() for k in range(len(block.index))}
    assert got == want
    import zstandard

    assert size < 0.8 * sum(len(zstandard.compress(np.array(x, "<u4").tobytes())) for x in want.values())
    assert {(r["doc_id"], r["n_tokens"]) for r in id_blocks.read_ids(blocks, d).collect()} == {(i, len(x)) for i, x in want.items()}
    long_only = id_blocks.train_dictionary(docs.limit(20).withColumn("text", F.repeat("text", 200)), path, 2)
    assert long_only  # documents longer than the sample's bound give a dictionary too


def test_small_samples_are_the_dictionary():
    few = [bytes(range(40)), bytes(range(40))]
    assert id_blocks.shared_dictionary(few, 64 << 10) == b"".join(few) and id_blocks.shared_dictionary([], 64) == b""
    d = id_blocks.shared_dictionary(few, 64 << 10)
    block = id_blocks.Block(id_blocks.write_block([(1, few[0])], 0, d), d)
    assert block.ids(0) == few[0] and len(block.body) < 30


# --- 8 near duplicates ---


def plain_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_near_dups_equal_brute_force(docs, empty, size):
    want = plain_components(rows_of(docs), size, 80)
    out = near_dups.link(docs, size, 80).collect()
    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])
    assert near_dups.link(empty).count() == 0


def test_near_dups_equal_their_sql(spark):
    import duckdb

    from veilspark.llm.queries import ORACLES, QUERIES

    sf_dir = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    out = QUERIES["op8_near_dups"](spark, sf_dir)
    want = duck.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLES['op8_near_dups']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and any(not r[-1] for r in want)


def test_near_dups_chain_and_blocks(spark, monkeypatch):
    """A drifting chain of edits in one large bucket: many components' worth of pairs under the limit, blocks of few."""
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(60):
        rows.append((rnd.randrange(10**6), " ".join(words)))
        words[rnd.randrange(100)] = f"n{i}"
        words[rnd.randrange(100)] = f"m{i}"
    want = plain_components(rows, 4, 80)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in near_dups.link(df, 4, 80).collect()} == {i: c for i, (_, c) in want.items()}
    kept = near_dups.first_of_each(df.withColumn("Gone", F.lit(1)), 4, 80)
    assert kept.columns == [*df.columns, "Gone"] and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}


def test_pruning_keeps_what_is_similar():
    rnd = np.random.default_rng(3)
    bounds = near_dups.pruning_bounds(0.8, 1e-7)
    a = rnd.integers(0, 60000, (4000, near_dups.KEPT_VALUES)).astype(np.uint16)
    b = np.where(rnd.random(a.shape) < 0.8, a, a + 1)
    assert len(near_dups.survive(a, b, bounds)) == 4000
    b = np.where(rnd.random(a.shape) < 0.3, a, a + 1)
    assert len(near_dups.survive(a, b, bounds)) < 40


def test_components_of_links(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {}
    for a, b in links:
        ra, rb = root.get(a, {a}), root.get(b, {b})
        both = ra | rb
        for x in both:
            root[x] = both
    got = {r["id"]: r["component"] for r in near_dups.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    for x, group in root.items():
        assert got.get(x, x) == min(group)


# --- 9 WARC ---


def test_warc_round_trip_and_pushdown(spark):
    big = "x" * 150
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (9, None, big), (3, "http://a/3", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "ü\r\nb", "é" * 60), (2, "http://a/2", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("Payload", F.lit(1))
    path = near_dups.cut(pages, "x").inputFiles()[0].rsplit("/", 1)[0] + "-warc"
    got = warc.round_trip(pages, path).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), sha256(html).hexdigest())
        first = r["page_id"] in (5, 9)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if first else ("response", None))
    back = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit' and page_id > 5")
    assert [(r["page_id"], r["payload"]) for r in back.collect()] == [(9, None)]
    empty = warc.round_trip(pages.filter("page_id > 99"), path + "-empty")
    assert empty.count() == 0


def test_warc_skips_without_decoding(monkeypatch):
    import io

    from pyspark.sql.datasource import EqualTo

    row = lambda i, body: {"page_id": i, "target_uri": "u", "record_type": "response", "payload_bytes": len(body), "payload_digest": "d", "refers_to": None, "payload": body}
    data = b"".join(warc.pack(row(i, bytes([65 + i]) * 500)) for i in range(5))
    import gzip

    assert gzip.decompress(data).count(b"WARC/1.1") == 5
    decoded = []
    real = warc.zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", lambda *a: decoded.append(1) or real(*a))
    (one,) = warc.records(io.BytesIO(data), [EqualTo(("page_id",), 3)])
    assert one[0] == 3 and one[-1] == b"D" * 500 and len(decoded) == 6


def test_warc_append_overwrite_and_valid_headers(spark, tmp_path):
    path = str(tmp_path / "own")
    pages = lambda a, b: spark.createDataFrame([(i, f"http://a/{i}", "y" * 120 if i % 2 else f"page {i}") for i in range(a, b)], "page_id bigint, url string, html string")
    read = lambda: sorted(r["page_id"] for r in spark.read.format("warc").load(path).collect())
    warc.archive(pages(0, 5), path)
    warc.archive(pages(5, 8), path)
    warc.archive(pages(8, 9), path)
    assert read() == list(range(9))
    warc.archive(pages(20, 23), path, mode="overwrite")
    assert read() == [20, 21, 22] and len(list(tmp_path.glob("own/*.warc.gz"))) == len(warc.archives(path))
    whole = b"".join(__import__("gzip").decompress(open(x, "rb").read()) for x, _ in warc.archives(path))
    heads = [warc.headers(x.split(b"\r\n\r\n")[0].split(b"\r\n")) for x in whole.split(b"WARC/1.1\r\n")[1:]]
    assert len(heads) == 3
    for h in heads:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", h["warc-record-id"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"]) and h["warc-payload-digest"].startswith("sha256:")
        assert ("warc-profile" in h) == (h["warc-type"] == "revisit") == ("warc-refers-to" in h)


def test_warc_joins_many_repeats_by_shuffling(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "z" * 200 if i % 3 == 0 else None if i % 3 == 1 else f"{i}" * 200) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = sorted(map(tuple, warc.round_trip(pages, str(tmp_path / "a")).collect()), key=str)
    monkeypatch.setattr(warc, "FEW", 0)
    assert sorted(map(tuple, warc.round_trip(pages, str(tmp_path / "b")).collect()), key=str) == want
    assert sum(r[3] == "revisit" for r in want) == 19


def foreign_archive():
    body = b"<html>first</html>"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    parts = [
        ("WARC/1.0", [("WARC-Type", "warcinfo"), ("Content-Type", "application/warc-fields")], b"software: hand\r\n"),
        ("WARC/1.0", [("WARC-Type", "response"), ("warc-target-uri", "<http://f/1>"), ("WARC-Payload-Digest", "sha1:ABC"), ("Content-Type", "application/http; msgtype=response")], http),
        ("WARC/1.1", [("WARC-Type", "resource"), ("WARC-Target-URI", "http://f/2"), ("X-Long", "a\r\n b"), ("Content-Type", "text/plain")], b"plain text"),
        ("WARC/1.1", [("WARC-Type", "revisit"), ("WARC-Target-URI", "http://f/1"), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    return [(v + "\r\n" + "".join(f"{k}: {x}\r\n" for k, x in hs) + f"Content-Length: {len(b)}\r\n\r\n").encode() + b + b"\r\n\r\n" for v, hs, b in parts]


def test_warc_reads_archives_of_others(spark, tmp_path):
    import gzip

    parts = foreign_archive()
    files = {"a.warc": b"".join(parts), "b.warc.gz": b"".join(map(gzip.compress, parts)), "c.warc.gz": gzip.compress(b"".join(parts)), "ignored.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = [("warcinfo", None, 16, None, b"software: hand\r\n"), ("response", "http://f/1", 18, "sha1:ABC", b"<html>first</html>"), ("resource", "http://f/2", 10, None, b"plain text"), ("revisit", "http://f/1", None, None, None)]
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    got = Counter((r["record_type"], r["target_uri"], r["payload_bytes"], r["payload_digest"], r["payload"] and bytes(r["payload"])) for r in rows)
    assert got == Counter(want * 3) and all(r["page_id"] is None for r in rows)
    one = spark.read.format("warc").option("payload", "false").load(str(tmp_path / "a.warc"))
    assert [(r["target_uri"], r["payload"]) for r in one.filter("payload_bytes = 18").collect()] == [("http://f/1", None)]
    assert [r["target_uri"] for r in one.filter("record_type = 'resource'").collect()] == ["http://f/2"]


def test_warc_damage_is_an_error():
    import io

    data = warc.pack({"page_id": 1, "target_uri": "u", "record_type": "response", "payload_bytes": 3, "payload_digest": "d", "refers_to": None, "payload": b"abc"})
    assert [r[-1] for r in warc.records(io.BytesIO(data))] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-8] + b"\x00" * 8)))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"".join(foreign_archive())[:400])))


# --- 10 lines ---


def test_line_removal(spark, docs, empty):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    rows = rows_of(docs)
    found = {}
    for i, t in rows:
        for line in t.split("\n"):
            if key(line):
                found.setdefault(key(line), set()).add(i)
    for bits in (12, 22):
        out = line_dedup.digest(docs, min_docs=5, log2_bits=bits + 6).collect()
        want = Counter()
        for i, t in rows:
            lines = t.split("\n")
            kept = [x for x in lines if len(found.get(key(x), ())) < 5]
            want[i, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in out) == want
    assert any(n for (_, _, n, _) in want)
    first = line_dedup.drop_lines(docs.withColumn("Drop", F.lit(1)), min_docs=5, keep_first=True).collect()
    held = Counter(key(x) for r in first for x in (r["text"] or "").split("\n"))
    assert held["shared line of words"] == 1
    assert line_dedup.digest(empty).count() == 0


def test_line_removal_is_row_by_row(spark):
    """Rows that share an id or have none lose their own repeated lines only; equal rows lose the same."""
    rows = [(i, f"own {i}\nshared\n last {i}", "en", "s", 1) for i in range(12)]
    rows += [(None, "alpha\nbeta\ngamma", "en", "s", 1), (None, "x\n Shared \ny", "en", "s", 1), (50, "shared\nz1", "en", "s", 1), (50, "keep me\nz2", "en", "s", 1), (51, "a\nshared", "en", "s", 1), (51, "a\nshared", "en", "s", 1), (52, None, "en", "s", 1), (53, "shared\nSHARED", "en", "s", 1)]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, SCHEMA).withColumn("CELLS", F.lit(1)), min_docs=10)
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    key = lambda x: x.strip().lower()
    want = Counter()
    for i, t, *_ in rows:
        kept = [x for x in (t or "").split("\n") if key(x) != "shared"]
        n = len((t or "").split("\n"))
        want[i, None if t is None else "\n".join(kept), n, n - len(kept)] += 1
    assert got == want
    first = Counter((r["doc_id"], r["text"]) for r in line_dedup.drop_lines(spark.createDataFrame(rows[:12] + rows[14:18], SCHEMA), min_docs=10, keep_first=True).collect())
    assert first[0, rows[0][1]] == 1 and first[1, "own 1\n last 1"] == 1 and first[50, "z1"] == 1 and first[51, "a"] == 2


def test_filter_size_follows_the_lines(spark):
    frame = lambda n: spark.range(n).select(F.repeat(F.lit("a\n"), 999).alias("text"))
    assert [line_dedup.filter_bits(frame(n)) for n in (0, 10, 1000, 200_000)] == [20, 20, 23, 28]


def test_line_filters_are_dealt_alike_when_a_task_runs_again(docs):
    filters = line_dedup.task_filters(docs.repartition(6, "doc_id"), 1, 20)
    runs = [sorted((r["slice"], r["part"]) for r in filters.collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len({part for _, part in runs[0]}) > 1


def test_twice_filter_has_no_false_negatives():
    rnd = np.random.default_rng(2)
    parts = [rnd.integers(0, 3000, 800).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(3)]
    filters = []
    for p in parts:
        f = line_dedup.TwiceFilter(18)
        f.add(p)
        filters.append(f)
    for f in filters[1:]:
        line_dedup.merge_into(filters[0].once, filters[0].twice, np.concatenate([f.once, f.twice]))
    n = Counter(np.concatenate(parts).tolist())
    twice = np.array([k for k, v in n.items() if v > 1], np.uint64)
    assert filters[0].suspected(twice).all()
    once = np.array([k for k, v in n.items() if v == 1], np.uint64)
    assert filters[0].suspected(once).mean() < 0.3


def test_scratch_is_cleared(spark):
    import os

    from veilspark.llm import common

    path = common.cut(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.clear(spark)
    assert not os.path.exists(path)


# --- pipeline ---


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    fresh = lambda n: " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(500)}" for _ in range(n))
    item = fresh(20)
    base = fresh(120)
    rows = [(i, fresh(70), "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(100 + i, fresh(70) + "\nsign up for our daily letter\n" + fresh(5), "en", "s1", 0) for i in range(12)]
    rows += [(200 + i, base + (" tail" if i else ""), "en", "s2", 0) for i in range(3)]
    rows += [(300, fresh(40) + " " + item + " " + fresh(40), "en", "s0", 0), (301, "too short", "en", "s0", 0), (302, None, None, None, None)]
    for name, data, schema in (("documents", rows, SCHEMA), ("benchmark", [(1, item)], "item_id bigint, text string")):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {r[0] for r in rows} - {201, 202, 300, 301, 302}
    for i, t, *_ in rows:
        if i in out:
            want = t if i <= 100 else t.replace("\nsign up for our daily letter", "")
            assert out[i]["text"] == want and out[i]["n_chars"] == len(want) or i < 100 and out[i]["text"] == t
            assert out[i]["round_trip"] and pieces().decode(out[i]["token_ids"]) == want and out[i]["n_tokens"] == len(out[i]["token_ids"])
