"""The detection engine: golden cases, plain Python twins of the Spark expressions, and every query against its SQL."""

import json
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.functions import geometry as g
from veilspark.functions import lexicon as lx
from veilspark.functions.checksum import verhoeff_ok, verhoeff_ok_py
from veilspark.functions.spans import first_term, line_around, spans_of
from veilspark.operators import banks, context, decision, evaluation, fusion, hybrid, layout, names, quality, redaction, registry, rendering, review, session, text_layer
from veilspark.operators import detectors as d
from veilspark.plans import catalog
from veilspark.schema import BLOCKS, DETECTIONS
from veilspark.sources import files, parsed, plans, text

DATA = "/root/testdata/sf0.001"


def blocks(spark, *texts, pages=None):
    rows = [(1, pages[i] if pages else 1, i, "text", t, (0.0, 30.0 * i, 100.0, 30.0 * i + 20)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, BLOCKS)


def scan(spark, det, *texts, **kw):
    return [(r["text"], r["start"], r["end"], round(r["confidence"], 2)) for r in d.scan(blocks(spark, *texts), det, **kw).orderBy("block_ord", "start", "pattern_ord").collect()]


def values(spark, det, *texts):
    return [x[0] for x in scan(spark, det, *texts)]


# --- spans and checksums ---


def test_spans_equal_finditer(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab12 .-+é🎉\n9") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for p in (r"[0-9]+", r"(?<![0-9])[0-9]{2}(?![0-9])", r"[a-b][^ ]", r"\S+"):
        got = {r["i"]: [(s["value"], s["start"], s["end"]) for s in r["s"]] for r in df.select("i", spans_of(F.col("t"), p).alias("s")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(m.group(), m.start(), m.end()) for m in re.finditer(p, t)]


def test_verhoeff(spark):
    good = ["226251716424", "555566667771", "444455556666"]
    assert all(map(verhoeff_ok_py, good)) and not verhoeff_ok_py("226251716425") and not verhoeff_ok_py("123456789012")
    rnd = random.Random(1)
    numbers = good + ["".join(rnd.choice("0123456789") for _ in range(12)) for _ in range(300)]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", verhoeff_ok(F.col("n")).alias("ok")).collect()
    assert all(r["ok"] == verhoeff_ok_py(r["n"]) for r in got)


# --- detectors, golden cases ---


@pytest.mark.parametrize("text_,found", [("AAAAA1111A", []), ("AAAPA1111A", ["AAAPA1111A"]), ("(PPPPP1111P)", ["PPPPP1111P"]), ("AAADP1111P", []), ("aaapa1111a", []), ("ABCD1234E", [])])
def test_pan(spark, text_, found):
    assert values(spark, d.PAN, text_) == (found if text_ != "AAAAA1111A" else ["AAAAA1111A"])


def test_aadhaar(spark):
    for t in ("226251716424", "2262 5171 6424", "2262-5171-6424"):
        assert values(spark, d.AADHAAR, t) == ["226251716424"]
    assert values(spark, d.AADHAAR, "555566667771 and 444455556666") == ["555566667771", "444455556666"]
    assert values(spark, d.AADHAAR, "2262 5171 6424 then 226251716424") == ["226251716424"]
    for t in ("000000000003", "123456789010", "1234567890123", "UPI/DR/226251716424/Miss", "100224490779/SBIN"):
        assert values(spark, d.AADHAAR, t) == []


def test_email(spark):
    assert values(spark, d.EMAIL, "a@b.com, c@d.org, e@f.net user+tag@example.co.uk") == ["a@b.com", "c@d.org", "e@f.net", "user+tag@example.co.uk"]
    assert scan(spark, d.EMAIL, "pooja569@hotmail.comPhone: 9876543210") == [("pooja569@hotmail.com", 0, 20, 0.9)]
    for t in ("user@example..com", "x" * 65 + "@a.com", "30524@sbi.coin", "admin@internal.ledger"):
        assert values(spark, d.EMAIL, t) == []


def test_phone(spark):
    for t, c in (("9876543210", 0.85), ("+919876543210", 0.9), ("+91-9876543210", 0.9), ("09876543210", 0.9), ("98765 43210", 0.85), ("987 654 3210", 0.85), ("9876-543-210", 0.85), (": 8989796847", 0.85)):
        assert [x[3] for x in scan(spark, d.PHONE, t)] == [c], t
    assert values(spark, d.PHONE, "9876543210 and 98765 43210") == ["98765 43210"]  # patterns in order, not places
    assert values(spark, d.PHONE, "5123456789") == [] and values(spark, d.PHONE, "/CNRB/9179083184/Paym") == []
    assert values(spark, d.PHONE, "call 9876543210", "again +919876543210") == ["9876543210"]


def test_phone_fold_depends_on_order(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for doc in range(60):
        kept = []
        for k in range(rnd.randint(1, 8)):
            raw = "".join(rnd.choice("12") for _ in range(rnd.randint(1, 4)))
            rows.append((doc, 1, k, "phone", 3, "PHONE", raw, 0, len(raw), (0.0, 0.0, 1.0, 1.0), 0.8, [], 0))
            if not any(raw in x or x in raw for x in kept):
                kept.append(raw)
        want[doc] = kept
    got = {}
    for r in d.without_contained(spark.createDataFrame(rows, DETECTIONS)).orderBy("doc_id", "block_ord").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == want


def test_upi_ifsc(spark):
    assert scan(spark, d.UPI, "user@ybl") == [("user@ybl", 0, 8, 0.95)]
    assert [x[3] for x in scan(spark, d.UPI, "user@unknownhandle u@YBL")] == [0.7, 0.7]
    for t in ("user@example.com", "user@@ybl", "user@ybl..com", "user@ybl."):
        assert values(spark, d.UPI, t) == []
    assert values(spark, d.UPI, "a@ybl", "a@ybl") == ["a@ybl"]
    assert values(spark, d.IFSC, "SBIN0012345 HDFC0001234 sbin0012345 XXSBIN0ABCDEFGG") == ["SBIN0012345", "HDFC0001234", "SBIN0ABCDEF"]


def test_account(spark):
    assert scan(spark, d.ACCOUNT, "Account Number: 40798662399") == [("40798662399", 16, 27, 0.85)]
    assert [x[3] for x in scan(spark, d.ACCOUNT, "Some header", "40798662399 credited")] == [0.7]
    for label in ("Account Number", "CIF Number", "CKYCR Number"):
        assert [x[3] for x in scan(spark, d.ACCOUNT, label, ": 50073645071003")] == [0.85]
    for t in ("0097737162096 AT 30524", "0099509044300AT30524", "UPI/DR/40798662399/PAYEE", "HDFC05717000027455", "Account: 00000000000", "Account: 123456789012", "A/c 9876543210"):
        assert values(spark, d.ACCOUNT, t) == [], t
    assert values(spark, d.ACCOUNT, "Zodiac 123456789") == ["123456789"]
    assert values(spark, d.ACCOUNT, "Account 12345678901234567890") == ["123456789012345678"]


def test_custom_detector(spark):
    own = d.custom("five", "CODE", [r"[0-9]{5}", "ABC"], confidence=lambda raw, *_: F.when(raw != "00000", 0.5))
    assert scan(spark, own, "id: 12345 ABC 00000") == [("12345", 4, 9, 0.5), ("ABC", 10, 13, 0.5)]


def test_names(spark):
    out = names.scan_names(blocks(spark, "Maya Kulkarni", "maya.kulkarni.work@example.com linkedin.com/in/mayakulkarni", "github.com/MayaKulkarni", "MayaKulkarni_DE_v1.pdf", "a plain sentence, mayan ruins")).collect()
    assert {(r["text"], r["confidence"]) for r in out} == {("Maya", 0.9), ("Kulkarni", 0.9), ("maya", 0.9), ("kulkarni", 0.9), ("mayakulkarni", 0.9), ("MayaKulkarni", 0.9)}
    assert {r["confidence"] for r in names.scan_names(blocks(spark, "priya.patel@example.com only")).collect()} == {0.6}
    assert names.scan_names(blocks(spark, "State Bank Of India")).count() == 0
    assert names.scan_names(blocks(spark, "30524@sbi.co.in info@x.com raj.k@x.com")).count() == 0
    got = {(r["text"], r["start"]): r["reasons"] for r in names.scan_names(blocks(spark, "ann.kulkarni+x@y.org github.com/rohankulkarni linkedin.com/in/RohanPillai", "xRohanPillaiY rohanx kulkarni1 aRohan")).collect()}
    assert got[("rohankulkarni", 32)] == ["profile handle 'rohankulkarni'", "contains email-derived token 'kulkarni'"]
    assert got[("kulkarni", 4)] == ["derived from email local part 'ann.kulkarni'", "contained in profile handle 'rohankulkarni'"]
    assert got[("Rohan", 32)] == ["derived from profile handle 'RohanPillai'"] and ("RohanPillai", 1) in got and ("Rohan", 1) not in got and ("rohan", 14) not in got


def test_registry(spark):
    r = registry.default_registry()
    assert r.names == ["pan", "aadhaar", "email", "phone", "upi", "ifsc", "account", "name"]
    with pytest.raises(ValueError):
        r.run(blocks(spark, "x"), ["nothing"])
    out = r.run(blocks(spark, "AAAPA1111A a@b.com a@ybl"), ["email", "pan"])
    assert sorted(x["detector_name"] for x in out.collect()) == ["email", "pan"]
    assert r.unregister("pan").names[0] == "aadhaar"


def test_partition_count_does_not_matter(spark):
    s = catalog.S(spark, DATA).limit(400).cache()
    key = lambda df: sorted((r["doc_id"], r["block_ord"], r["detector_name"], r["start"], r["confidence"]) for r in df.collect())
    reg = registry.default_registry()
    assert key(reg.run(s.coalesce(1))) == key(reg.run(s.repartition(7)))


# --- context ---


def _scored(spark, det, *texts):
    b = blocks(spark, *texts)
    return context.apply(d.scan(b, det), b).collect()


def test_context(spark):
    assert round(_scored(spark, d.AADHAAR, "Aadhaar No: 226251716424")[0]["confidence"], 2) == 1.0
    assert round(_scored(spark, d.AADHAAR, "UTR 226251716424 transfer completed")[0]["confidence"], 2) == 0.6
    assert round(_scored(spark, d.AADHAAR, "Aadhaar ref: 226251716424")[0]["confidence"], 2) == 1.0
    assert _scored(spark, d.PHONE, "UTR: 7987465071") == [] and _scored(spark, d.PHONE, "Ref ID: 8223027920") == []
    (r,) = _scored(spark, d.PHONE, "UTR mentioned, call +91-7987465071")
    assert round(r["confidence"], 2) == 0.55
    assert round(_scored(spark, d.PHONE, "Mobile: 7987465071 (txn ref 12345)")[0]["confidence"], 2) == 0.95
    (r,) = _scored(spark, d.PHONE, "Mobile", "7987465071")
    assert round(r["confidence"], 2) == 0.9 and "surrounding" in r["reasons"][-1]
    (r,) = _scored(spark, d.ACCOUNT, "x", "30524123456789 credited", "NEFT reference")
    assert r["confidence"] < 0.5 and decision.suggest(_frame(spark, [r]), decision.get_policy()).first()["suggested_action"] == "keep"
    assert _scored(spark, d.EMAIL, "UTR a@b.com")[0]["confidence"] == 0.9


def _frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in r.__fields__) for r in rows], DETECTIONS)


def test_line_and_terms(spark):
    df = spark.createDataFrame([("ab\ncd 12 ef\ngh", 6, 8)], "t string, s int, e int")
    assert df.select(line_around(F.col("t"), F.col("s"), F.col("e"))).first()[0] == "cd 12 ef"
    t = spark.createDataFrame([("my A/C here",), ("macaroni",), ("REF and utr",)], "t string")
    assert [r[0] for r in t.select(first_term(F.col("t"), ("utr", "a/c", "ref"))).collect()] == ["a/c", None, "utr"]


# --- fusion ---


def det(start, end, conf, name="pan", kind="PAN", page=1, block=0, reasons=("r",), box=(0.0, 0.0, 100.0, 20.0)):
    return (1, page, block, name, 0, kind, "x" * (end - start), start, end, box, conf, list(reasons), 0)


def test_fusion(spark):
    fuse = lambda *rows: sorted((r["detection_type"], r["page_number"], r["start"], r["end"], r["confidence"]) for r in fusion.fuse(spark.createDataFrame(list(rows), DETECTIONS)).collect())
    assert fuse(det(0, 15, 0.9), det(5, 15, 0.95)) == [("PAN", 1, 5, 15, 0.95)]
    assert fuse(det(0, 15, 0.95, "ner_model"), det(0, 15, 0.85)) == [("PAN", 1, 0, 15, 0.85)]
    assert len(fuse(det(0, 10, 0.9), det(10, 20, 0.9))) == 2
    assert fuse(det(0, 10, 0.8), det(5, 15, 0.95), det(12, 25, 0.9)) == [("PAN", 1, 5, 15, 0.95)]
    assert len(fuse(det(0, 10, 0.8), det(0, 10, 0.8, kind="UPI"), det(0, 10, 0.8, page=2))) == 3
    assert len(fuse(det(0, 10, 0.8), det(0, 10, 0.9, block=1, box=(0.0, 40.0, 100.0, 60.0)))) == 2
    rows = spark.createDataFrame([det(0, 15, 0.9, reasons=("a", "b")), det(5, 15, 0.95, reasons=("b", "c"))], DETECTIONS)
    assert fusion.fuse(rows).first()["reasons"] == ["b", "c", "a"]
    log = fusion.merge_log(rows).first()
    assert log["reason"] == "higher confidence (0.95>0.90)" and (log["kept_start"], log["merged_start"]) == (5, 0)


def test_fusion_equals_plain_fold(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for doc in range(80):
        mine = []
        for k in range(rnd.randint(1, 6)):
            a = rnd.randrange(12)
            mine.append((doc, 1, k, rnd.choice(["pan", "ner"]), 0, "PAN", "x", a, a + rnd.randint(1, 8), (0.0, 0.0, 10.0, 10.0), rnd.choice([0.5, 0.7, 0.9]), [], 0))
        rows += mine
        prio = lambda x: lx.TIERS["regex" if x[3] == "pan" else "heuristic"]
        kept = []
        for x in sorted(mine, key=lambda x: (x[7], -prio(x), -x[10], x[4], x[2])):
            if kept and kept[-1][7] < x[8] and x[7] < kept[-1][8]:
                y = kept[-1]
                kept[-1] = y if (prio(y), y[10]) >= (prio(x), x[10]) else x
            else:
                kept.append(x)
        want[doc] = sorted((x[2], x[7]) for x in kept)
    got = {}
    for r in fusion.fuse(spark.createDataFrame(rows, DETECTIONS)).collect():
        got.setdefault(r["doc_id"], []).append((r["block_ord"], r["start"]))
    assert {k: sorted(v) for k, v in got.items()} == want


# --- decisions and redaction ---


def test_policies(spark, tmp_path):
    rows = spark.createDataFrame([det(0, 5, c) for c in (0.95, 0.9, 0.7, 0.5, 0.70 - 0.20, 0.85 - 0.35, 0.85 + 0.05)], DETECTIONS)
    acts = lambda p: sorted(r["suggested_action"] for r in decision.suggest(rows, p).collect())
    assert acts(decision.get_policy()) == sorted(["redact", "redact", "ask", "ask", "keep", "ask", "redact"])
    assert set(acts(decision.get_policy("kyc"))) == {"keep"} and set(acts(decision.get_policy("minimal"))) == {"ask"}
    own = decision.Policy("own", types={"PAN": {"action": "redact", "allow_values": ["xxxxx"]}})
    assert set(acts(own)) == {"keep"}
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"name": "file", "types": {"PAN": {"action": "ask"}}}))
    assert set(acts(decision.get_policy(str(path)))) == {"ask"}
    for bad in (lambda: decision.get_policy("nothing"), lambda: decision.Policy("x", auto_redact_above=0.2), lambda: decision.Policy("x", default_action="burn")):
        with pytest.raises(ValueError):
            bad()
    e = decision.suggest(registry.with_ids(rows), decision.get_policy())
    with pytest.raises(ValueError):
        decision.resolve(e)
    assert decision.resolve(e, accept_suggestions=True).count() == 6
    assert decision.resolve(decision.decide_all(e, F.lit(True), "keep")).count() == 0


def test_redaction(spark):
    rows = spark.createDataFrame([det(0, n, 0.9) for n in (2, 5, 40)], DETECTIONS)
    assert sorted(len(r["replacement_text"]) for r in redaction.plan(rows).collect()) == [3, 5, 32]
    assert redaction.plan(rows, redaction.HIGHLIGHT).filter("replacement_text = text").count() == 3
    assert redaction.plan(rows, replacement="[gone]").filter("replacement_text = '[gone]'").count() == 3
    b = blocks(spark, "mail a@b.com or c@d.org now", "none")
    out = redaction.redacted_blocks(b, redaction.plan(d.scan(b, d.EMAIL))).orderBy("block_ord").collect()
    assert [r["redacted_text"] for r in out] == ["mail ******* or ******* now", "none"]
    over = spark.createDataFrame([("abcdefghij", [(0, 4, "***"), (2, 6, "###"), (3, 4, "!")])], "t string, s array<struct<start:int,end:int,replacement:string>>")
    assert over.select(redaction.spliced(F.col("t"), F.col("s"))).first()[0] == "*****ghij"


def test_merged_boxes(spark):
    rows = [det(0, 3, 0.9, box=b) for b in ((0.0, 0.0, 10.0, 10.0), (20.0, 0.0, 30.0, 10.0), (9.0, 5.0, 21.0, 8.0), (50.0, 50.0, 60.0, 60.0))]
    out = redaction.merged_jobs(redaction.plan(spark.createDataFrame(rows, DETECTIONS))).collect()
    assert sorted(tuple(r["bbox"]) for r in out) == [(0.0, 0.0, 30.0, 10.0), (50.0, 50.0, 60.0, 60.0)]
    # an edge is no overlap; the wider replacement stays, the newer where both are as wide
    rows = [det(k, k + n, 0.9, box=b) for k, (n, b) in enumerate([(3, (0.0, 0.0, 10.0, 10.0)), (4, (0.0, 10.0, 10.0, 20.0)), (5, (0.0, 5.0, 10.0, 9.0)), (6, (2.0, 12.0, 6.0, 14.0)), (7, (50.0, 0.0, 50.0, 9.0)), (8, (49.0, 0.0, 51.0, 9.0))])]
    out = redaction.merged_jobs(redaction.plan(spark.createDataFrame(rows, DETECTIONS))).collect()
    assert sorted((tuple(r["bbox"]), len(r["replacement_text"])) for r in out) == [((0.0, 0.0, 10.0, 10.0), 5), ((0.0, 10.0, 10.0, 20.0), 4), ((49.0, 0.0, 51.0, 9.0), 8), ((50.0, 0.0, 50.0, 9.0), 7)]


def test_decisions_the_latest_counts(spark):
    e = spark.createDataFrame([(1, "a", None), (1, "b", "keep"), (1, "c", "keep"), (2, "a", None)], "doc_id bigint, detection_id string, decision string")
    new = spark.createDataFrame([(1, "a", "keep", 1), (1, "a", "redact", 3), (1, "a", "keep", 2), (1, "b", "redact", 1), (1, "b", None, 2), (9, "z", "keep", 1)], "doc_id bigint, detection_id string, decision string, decided_ord int")
    assert sorted(map(tuple, decision.decide(e, new).collect()), key=str) == [(1, "a", "redact"), (1, "b", None), (1, "c", "keep"), (2, "a", None)]


def test_plan_json_round_trip(spark, tmp_path):
    b = blocks(spark, "mail a@b.com", "AAAPA1111A")
    e = decision.suggest(registry.with_ids(registry.default_registry(names=False).run(b)), decision.get_policy())
    e = e.withColumns({"source_path": F.lit("p"), "source_sha256": F.lit("h")})
    plans.write(e, "share-with-ai", f"{tmp_path}/plan")
    back = plans.read(spark, f"{tmp_path}/plan")
    key = lambda df: sorted((r["detection_id"], r["text"], r["suggested_action"], r["entry_ord"]) for r in df.collect())
    assert key(back) == key(e) and back.count() == 2
    assert plans.from_json(spark.createDataFrame([("not json",)], "plan string")).count() == 0


# --- geometry, hybrid, layout, quality, banks ---


def test_range_box(spark):
    words = [("alpha", (0.0, 0.0, 50.0, 10.0)), ("bravo", (60.0, 0.0, 110.0, 10.0)), ("charlie", (120.0, 0.0, 190.0, 10.0))]
    df = spark.createDataFrame([("alpha bravo charlie", words, (0.0, 0.0, 200.0, 20.0), a, b) for a, b in ((6, 11), (8, 11), (0, 19), (100, 110))], "t string, w array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>, b struct<x0:double,y0:double,x1:double,y1:double>, s int, e int")
    got = [tuple(r[0]) for r in df.select(g.range_box(F.col("t"), F.col("w"), F.col("b"), F.col("s"), F.col("e"))).collect()]
    assert got == [(60.0, 0.0, 110.0, 10.0), (80.0, 0.0, 110.0, 10.0), (0.0, 0.0, 190.0, 10.0), (0.0, 0.0, 200.0, 20.0)]


def test_hybrid(spark):
    a = spark.createDataFrame([(1, 1, 0, "text", "native", (0.0, 0.0, 100.0, 20.0)), (1, 1, 1, "image", "", (0.0, 50.0, 100.0, 90.0))], BLOCKS)
    b = spark.createDataFrame([(1, 1, 0, "text", "same", (5.0, 0.0, 100.0, 20.0)), (1, 1, 1, "text", "new", (0.0, 50.0, 100.0, 90.0)), (1, 2, 0, "text", "other page", (0.0, 0.0, 9.0, 9.0))], BLOCKS)
    assert sorted((r["text"], r["provenance"]) for r in hybrid.merge(a, b).collect()) == [("", "native"), ("native", "native"), ("new", "ocr"), ("other page", "ocr")]
    # pages pair by place: native 3 and 7 with OCR 1 and 2
    a = spark.createDataFrame([(1, 3, 0, "text", "first", (0.0, 0.0, 100.0, 20.0)), (1, 7, 0, "text", "second", (0.0, 0.0, 100.0, 20.0))], BLOCKS)
    b = spark.createDataFrame([(1, 1, 0, "text", "covered", (0.0, 0.0, 100.0, 20.0)), (1, 2, 0, "text", "below", (0.0, 50.0, 100.0, 70.0)), (1, 3, 0, "text", "more", (0.0, 0.0, 100.0, 20.0))], BLOCKS)
    assert sorted((r["page_number"], r["text"]) for r in hybrid.merge(a, b).collect()) == [(1, "first"), (2, "below"), (2, "second"), (3, "more")]


def test_quality(spark):
    texts = ["", "   ", "hello there my good friends", "\x00" * 8 + "hello", "�" * 50, "a b c d e f", "A" * 60 + " Bbb Bbb", "word " * 20]
    out = {r["t"]: r for r in quality.quality(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert out[""]["overall_score"] == out["   "]["overall_score"] == 0.0
    assert out["\x00" * 8 + "hello"]["printable_ratio"] < 0.7 and "low printable character ratio" in out["\x00" * 8 + "hello"]["quality_reasons"]
    assert out["�" * 50]["replace_penalty"] == 0.0 and out["a b c d e f"]["fragmentation_score"] < 0.6
    assert out["A" * 60 + " Bbb Bbb"]["token_quality"] < 0.6 and out["hello there my good friends"]["overall_score"] > 0.9
    pick = lambda *a: spark.range(1).select(quality.recommend(*(F.lit(x) for x in a))).first()[0]
    assert [pick(False, 1, True, False, s) for s in (0.29, 0.3, 0.69, 0.7)] == ["ocr", "hybrid", "hybrid", "native"]
    assert pick(True, 1, True, False, 1.0) == pick(False, 0, True, False, 1.0) == pick(False, 1, True, True, 1.0) == pick(False, 1, False, False, 1.0) == "ocr"
    scan_ = lambda *a: spark.range(1).select(quality.looks_scanned(*(F.lit(x) for x in a))).first()[0]
    assert [scan_(1, 3, 0.9), scan_(1, 4, 0.9), scan_(2, 1, 0.2), scan_(2, 1, 0.19), scan_(0, 9, 0.0)] == [False, True, False, True, False]
    route = lambda *a: spark.range(1).select(quality.route(F.lit(a[0]), a[1], a[2], F.lit(a[3]))).first()[0]
    assert [route("ocr", False, False, True), route("native", True, True, True), route("ocr", True, False, True), route("ocr", True, False, False), route("native", False, True, True)] == ["native", "native", "hybrid", "ocr", "hybrid"]


def test_layout(spark):
    rows = [("header", 10, 30), ("one", 200, 215), ("two", 220, 235), ("far", 300, 315), ("7", 780, 790), ("foot", 770, 779)]
    b = spark.createDataFrame([(1, 1, i, "text", t, (0.0, float(a), 50.0, float(z))) for i, (t, a, z) in enumerate(rows)] + [(1, 1, 9, "image", "", (0.0, 400.0, 9.0, 420.0))], BLOCKS)
    p = spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id bigint, page_number int, width double, height double")
    out = [(r["element_type"], r["text"]) for r in layout.elements(b, p).orderBy("reading_order").collect()]
    assert out == [("header", "header"), ("paragraph", "one two"), ("paragraph", "far"), ("image", ""), ("footer", "foot"), ("page_number", "7")]


def test_banks(spark):
    def best(t):
        return banks.best(banks.profiles(spark.createDataFrame([(1, 1, t)], "doc_id bigint, page_count bigint, text string"))).first()

    r = best("State Bank of India\nSBIN0012345\nAccount: 12345678901")
    assert (r["bank_name"], r["confidence"], r["account_number"], r["ifsc_code"]) == ("sbi", 0.8, "12345678901", "SBIN0012345")
    r = best("State Bank of India\nHDFC0001234")
    assert r["bank_name"] == "hdfc" and r["confidence"] == 0.8  # the code holds the alias, too
    assert best("from 01 April 2024 to 31 March 2025")["statement_end"].isoformat() == "2025-03-31"
    r = best("Statement Period: 01 Apr 2024 to 31 Mar 2025\nAccount Holder: John Doe")
    assert (r["bank_name"], round(r["confidence"], 2), r["account_holder"], r["statement_start"].isoformat()) == ("generic", 0.3, "John Doe", "2024-04-01")


# --- session, evaluation, sources, streaming ---


def test_marks_and_terms(spark, monkeypatch):
    b = blocks(spark, "Maya  KULKARNI and maya kulkarni", "Maya Kulkarni")
    terms = spark.createDataFrame([("Maya Kulkarni", "customer name", False, "a", False)], session.TERMS)
    found = session.instances(b, terms)
    assert sorted((r["text"], r["start"], r["detection_type"]) for r in found.collect()) == [("Maya  KULKARNI", 0, "CUSTOMER_NAME"), ("Maya Kulkarni", 33, "CUSTOMER_NAME"), ("maya kulkarni", 19, "CUSTOMER_NAME")]
    monkeypatch.setattr(session, "FEW_TERMS", 0)
    assert session.instances(b, terms).count() == 3
    monkeypatch.undo()
    assert session.instances(b, terms.limit(0)).count() == 0
    # white space other than a blank in a term reads the same in short and long lists
    tabbed = spark.createDataFrame([("\tMa\tBcd\n", "x", False, "a", False)], session.TERMS)
    short = session.instances(blocks(spark, "see ma  bcd"), tabbed).select("text", "start").collect()
    monkeypatch.setattr(session, "FEW_TERMS", 0)
    assert session.instances(blocks(spark, "see ma  bcd"), tabbed).select("text", "start").collect() == short and len(short) == 1
    monkeypatch.undo()
    exact = terms.withColumn("case_sensitive", F.lit(True))
    assert session.instances(b, exact).count() == 1
    none = registry.with_ids(d.scan(b, d.EMAIL))
    added, n = session.mark(none, found)
    # two of them share the block's box: one is the other's twin only if their texts are equal
    assert n.first()["added"] + n.first()["skipped"] == 3
    again, n2 = session.mark(added.select(*found.columns), found)
    assert again.count() == 0 and n2.first()["skipped"] == 3
    left, t = session.forget(session.remembered(b, terms, decision.get_policy()), terms, "maya kulkarni", "CUSTOMER_NAME")
    assert t.count() == 0 and left.count() == 1


def test_evaluation(spark):
    one = lambda rows: spark.createDataFrame(rows, "doc_id bigint, detection_type string, text string")
    out = {r["detection_type"]: r for r in evaluation.precision_recall(one([(1, "PHONE", "+91 98765-43210"), (1, "PHONE", "1"), (1, "PAN", "A")]), one([(1, "PHONE", "9876543210"), (2, "PAN", "A"), (1, "UPI", "z")])).collect()}
    assert (out["PHONE"]["tp"], out["PHONE"]["fp"], out["PHONE"]["fn"]) == (1, 1, 0) and out["PAN"]["recall"] == 0.0 and out["UPI"]["precision"] == 1.0
    base = spark.createDataFrame([("PHONE", 0.51, 1.0), ("PAN", 0.0, 0.0), ("UPI", 1.0, 0.5)], "detection_type string, precision double, recall double")
    assert [r["detection_type"] for r in evaluation.regressions(evaluation.precision_recall(one([(1, "PHONE", "1"), (1, "PHONE", "2")]), one([(1, "PHONE", "1")])), base.filter("detection_type = 'PHONE'")).collect()] == []


def test_text_source(spark):
    assert text.wrap_line("x" * 5 + " " + "y" * 5, 8) == ["xxxxx", "yyyyy"] and text.wrap_line("z" * 20, 8) == ["z" * 8, "z" * 8, "z" * 4]
    long = " ".join(["word"] * 40)
    docs = spark.createDataFrame([(1, "a\tb\n\n" + long), (2, None), (3, "\n" * 53 + "second page")], "doc_id bigint, text string")
    out = text.wrapped_blocks(docs).orderBy("doc_id", "block_ord").collect()
    assert out[0]["text"] == "a    b" and all(len(r["text"]) <= 82 for r in out) and out[-1]["page_number"] == 2
    assert " ".join(r["text"] for r in out[1:-1]) == long


def test_files(spark, tmp_path):
    import zipfile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "y.txt").write_text("plain é")
    (tmp_path / "z.pdf").write_bytes(b"%PDF-1.7")
    out = {r["name"]: r for r in files.extract_text(files.read_files(spark, str(tmp_path))).collect()}
    assert out["x.docx"]["text"] == "Hello\na | b" and out["y.txt"]["text"] == "plain é" and "no adapter" in out["z.pdf"]["error"]
    ok = {"tesseract": lambda: True, "rapidocr": lambda: False, "paddleocr": lambda: True}
    assert files.engine_chain(None, ok) == ["tesseract", "paddleocr"] and files.engine_chain("rapidocr", ok) == ["rapidocr"]
    with pytest.raises(ValueError):
        files.engine_chain("none", ok)
    fail = lambda n, b: 1 / 0
    assert files.first_that_works([("a", fail), ("b", lambda n, b: "text")], "n", b"") == "text"
    with pytest.raises(RuntimeError):
        files.first_that_works([("a", fail)], "n", b"")


def test_stream(spark, tmp_path):
    from veilspark.streaming import folder

    spark.createDataFrame([(1, "mail a@b.com"), (2, "call 9876543210")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/in")
    seen = []
    q = folder.run_batches(spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/in"), lambda df, n: seen.extend(r["detection_type"] for r in df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(seen) == ["EMAIL", "PHONE"]


# --- parsers, text layer, review, drawing ---


def test_parsers_give_blocks_with_boxes(spark, monkeypatch):
    monkeypatch.setattr(parsed, "_PARSERS", dict(parsed._PARSERS))
    page = {"page_number": 1, "width": 100.0, "height": 50.0, "rotation": 90, "encrypted": True, "images": [{"box": (0, 0, 10, 10), "data": b"12345", "mime_type": "image/png"}], "lines": [{"text": "a b", "box": (0, 0, 30, 5), "confidence": 0.5}, {"text": "  ", "box": (0, 0, 5, 5)}, {"text": "flat", "box": (0, 5, 5, 5)}]}
    parsed.register_parser("pdf", lambda name, data: [page, page | {"page_number": 2, "images": [], "lines": page["lines"][:1]}] if data else 1 / 0)
    found = spark.createDataFrame([(1, "x.pdf", b"%PDF"), (2, "y.pdf", b""), (3, "z.png", b"1"), (4, "t.txt", "one\ttwo\n\nthree é".encode()), (5, "q.xyz", b"")], "doc_id bigint, name string, content binary")
    pages = parsed.parse(found).cache()
    errors = {r["doc_id"]: r["error"] for r in pages.filter("error is not null").collect()}
    assert set(errors) == {2, 3, 5} and "ZeroDivisionError" in errors[2] and "ConversionError" in errors[3]
    rows = parsed.blocks(pages).orderBy("doc_id", "block_ord").collect()
    assert [(r["doc_id"], r["page_number"], r["block_ord"], r["block_type"], r["text"]) for r in rows] == [(1, 1, 0, "text", "a b"), (1, 1, 1, "image", ""), (1, 2, 2, "text", "a b"), (4, 1, 0, "text", "one    two"), (4, 1, 1, "text", "three é")]
    assert rows[0]["confidence"] == 0.5 and [w["bbox"]["x0"] for w in rows[0]["words"]] == [0.0, 20.0] and rows[1]["words"] is None
    assert [r["preview"] for r in parsed.listing(parsed.blocks(pages)).filter("doc_id = 1").orderBy("block_ord").collect()] == ["a b", "5 bytes", "a b"]
    d_ = {r["doc_id"]: r for r in quality.diagnose(parsed.blocks(pages), pages=pages.filter("error is null")).collect()}
    assert d_[1]["rotated_pages"] == [1, 2] and d_[1]["is_encrypted"] and d_[1]["recommendation"] == "ocr" and d_[4]["page_count"] == 1


def test_text_pages_equal_wrapped_blocks(spark):
    body = "\n".join(["short", "", "w" * 100, " ".join(["word"] * 40)] * 30)
    found = spark.createDataFrame([(1, "a.md", body.encode())], "doc_id bigint, name string, content binary")
    mine = [(r["page_number"], r["text"], tuple(r["bbox"])) for r in parsed.blocks(parsed.parse(found)).orderBy("block_ord").collect()]
    plain = [(r["page_number"], r["text"], tuple(r["bbox"])) for r in text.wrapped_blocks(spark.createDataFrame([(1, body)], "doc_id bigint, text string")).orderBy("block_ord").collect()]
    assert mine == plain and len(mine) > 53


def test_outdated(spark):
    sources = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "name string, modified bigint")
    done = spark.createDataFrame([("a", 5), ("a", 1), ("b", 4)], "name string, parsed_at bigint")
    assert sorted(r["name"] for r in parsed.outdated(sources, done).collect()) == ["b", "c"]


def test_ocr_lines_and_engines(monkeypatch):
    line = parsed.ocr_line([(200, 100), (600, 110), (590, 150), (190, 140)], "x", 97.0, 144.0, 250.0, 842.0)
    assert line == {"text": "x", "box": (95.0, 50.0, 250.0, 75.0), "confidence": 1.0}
    assert parsed.ocr_line([(0, 0), (5, 5)], " ", 1, 72, 9, 9) is None and parsed.ocr_line([(20, 0), (30, 5)], "off", 1, 72, 9, 9) is None
    monkeypatch.setattr(parsed, "ENGINES", {})
    monkeypatch.delenv(parsed.ENGINE_SETTING, raising=False)

    def broken(languages):
        raise OSError("no model")

    for e in (parsed.Engine("bad", (), broken), parsed.Engine("absent", ("no_such_module_",), broken), parsed.Engine("good", (), lambda languages: lambda png: [([(0, 0), (10, 10)], png.decode(), 0.5)])):
        parsed.register_engine(e)
    assert [e.name for e in parsed.engines()] == ["bad", "good"]
    run = parsed.ocr_parser(lambda name, data, dpi: [(1, 100.0, 100.0, data)], parsed.reader(parsed.engines()), 72.0)
    assert list(run("n", b"text")) == [{"page_number": 1, "width": 100.0, "height": 100.0, "lines": [{"text": "text", "box": (0.0, 0.0, 10.0, 10.0), "confidence": 0.5}]}]
    monkeypatch.setenv(parsed.ENGINE_SETTING, "bad")
    with pytest.raises(RuntimeError, match="no model"):
        list(parsed.ocr_parser(lambda name, data, dpi: [(1, 1.0, 1.0, data)], parsed.reader(parsed.engines()))("n", b""))
    monkeypatch.setenv(parsed.ENGINE_SETTING, "unknown")
    with pytest.raises(ValueError):
        parsed.engines()
    with pytest.raises(ValueError):
        parsed.Engine("", (), broken)


def test_character_edges(spark):
    words = [("Hi", (10.0, 0.0, 30.0, 10.0)), ("yo", (50.0, 0.0, 70.0, 10.0))]
    b = spark.createDataFrame([(1, 1, 0, "text", "Hi yo", (10.0, 0.0, 70.0, 10.0), words)], BLOCKS + ", words array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
    chars = [(1, 1, 7, i, c, (x, 1.0, x + w, 9.0)) for i, (c, x, w) in enumerate([("H", 11.0, 14.0), ("i", 25.0, 4.0), (" ", 29.0, 20.0), ("y", 60.0, 5.0), ("o", 65.0, 5.0)])]
    glyphs = text_layer.glyph_words(spark.createDataFrame(chars, "doc_id bigint, page_number int, run int, char_ord int, char string, bbox struct<x0:double,y0:double,x1:double,y1:double>"))
    assert sorted((r["word"], r["edges"]) for r in glyphs.collect()) == [("Hi", [11.0, 25.0, 29.0]), ("yo", [60.0, 65.0, 70.0])]
    out = text_layer.with_edges(b, glyphs)
    assert [(r["text"], r["edges"]) for r in text_layer.page_words(out).orderBy("word_ord").collect()] == [("Hi", [11.0, 25.0, 29.0]), ("yo", None)]
    boxes = out.select(*(g.range_box(F.col("text"), F.col("words"), F.col("bbox"), F.lit(a), F.lit(z), edges=True).alias(f"b{a}") for a, z in ((1, 2), (4, 5)))).first()
    assert (boxes["b1"]["x0"], boxes["b1"]["x1"]) == (25.0, 29.0) and (boxes["b4"]["x0"], boxes["b4"]["x1"]) == (60.0, 70.0)
    pages = spark.createDataFrame([(1, 1)], "doc_id bigint, page_number int")
    assert text_layer.one_page(out, pages, 1, 1).count() == 2
    with pytest.raises(ValueError):
        text_layer.one_page(out, pages, 1, 2)


def test_registry_extras(spark):
    b = blocks(spark, "mail maya@x.com", "call 9876543210", "id AB12 and AB99 and AB12")
    det = d.custom("own", "OWN", ["AB[0-9]{2}"])
    reg = registry.default_registry().register(d.hooked(det, lambda v: 0.75 if v != "AB99" else None))
    assert [(r["text"], r["confidence"]) for r in reg.run(b, ["own"]).orderBy("start").collect()] == [("AB12", 0.75), ("AB12", 0.75)]
    timed = {r["detector_name"]: r for r in reg.timed(b).collect()}
    assert list(timed) == reg.names and timed["email"]["n_detections"] == 1 and all(r["duration_ms"] > 0 for r in timed.values())
    assert reg.run(b, []).count() == 0
    named = blocks(spark, "maya@x.com", "To Maya").withColumn("words", g.words_with_boxes(F.col("text"), F.col("bbox")))
    box = next(r["bbox"] for r in registry.default_registry().run(named, ["name"], values_only=True).collect() if r["text"] == "Maya")
    assert box["x0"] > 40
    assert decision.list_policies() == ["kyc", "minimal", "share-with-ai"]


def _review(spark, *texts, **kw):
    b = blocks(spark, *texts)
    sources = spark.createDataFrame([(1, "one.txt", "abc")], "doc_id bigint, source_path string, source_sha256 string")
    return review.Review(b, sources, **kw)


def _texts(r):
    return [x["redacted_text"] for x in r.apply().orderBy("block_ord").collect()]


def test_review_run_decide_undo_save(spark, tmp_path):
    r = _review(spark, "Phone: 9876543210", "mail ab@x.com", "see Project Apollo")
    with pytest.raises(RuntimeError):
        r.entries  # noqa: B018
    r.run()
    assert _texts(r) == ["Phone: **********", "mail ********", "see Project Apollo"]
    r.decide_all(F.col("detection_type") == "EMAIL", decision.KEEP)
    assert _texts(r)[1] == "mail ab@x.com"
    assert r.undo() and not r.undo() and _texts(r)[1] == "mail ********"
    phone = r.entries.filter("detection_type = 'PHONE'").first()["detection_id"]
    r.decide(spark.createDataFrame([(1, phone, "redact", 1), (1, phone, "keep", 2)], "doc_id bigint, detection_id string, decision string, decided_ord int"))
    term = spark.createDataFrame([("project apollo", "client", False)], "term string, label string, case_sensitive boolean")
    counts = r.mark(term, remember=True).first()
    assert (counts["added"], counts["skipped"]) == (1, 0) and r.mark(term).first()["skipped"] == 1
    assert _texts(r) == ["Phone: 9876543210", "mail ********", "see **************"]
    kept = r.counts().first()
    assert (kept["n_redact"], kept["n_ask"], kept["n_keep"]) == (2, 0, 1) and r.pending().count() == 0
    r.apply(f"{tmp_path}/plan")
    saved = plans.read(spark, f"{tmp_path}/plan")
    again = _review(spark, "Phone: 9876543210", "mail ab@x.com", "see Project Apollo", saved=saved, terms=r.terms).run()
    assert _texts(again) == ["Phone: 9876543210", "mail ********", "see **************"]
    manual = again.entries.filter("detector_name = 'manual'").first()["detection_id"]
    assert again.unmark(manual).entries.filter("detector_name = 'manual'").count() == 0 and again.undo()
    again.rerun(force_ocr=False)
    assert again.entries.filter("decision is not null").count() == 0 and again.entries.filter("detector_name = 'remembered'").count() == 1
    again.forget("Project Apollo", "CLIENT")
    assert _texts(again)[2] == "see Project Apollo" and again.terms.count() == 0


def test_review_reads_by_ocr_where_needed(spark):
    rows = [(1, 1, 0, "text", "plain words of a good page with maya@x.com", (0.0, 0.0, 200.0, 10.0)), (2, 1, 0, "text", "���", (0.0, 0.0, 50.0, 10.0))]
    b = spark.createDataFrame(rows, BLOCKS)
    asked = []

    def ocr(ids):
        asked.extend(r["doc_id"] for r in ids.collect())
        read = [(2, 7, 0, "text", "covered", (0.0, 0.0, 50.0, 10.0)), (2, 7, 1, "text", "call 9876543210", (0.0, 20.0, 90.0, 30.0))]
        return spark.createDataFrame(read, BLOCKS).join(ids, "doc_id", "left_semi")

    sources = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id bigint, source_path string, source_sha256 string")
    r = review.Review(b, sources, ocr=ocr, registry=registry.default_registry(names=False)).run()
    assert set(asked) == {2}
    got = [(x["doc_id"], x["page_number"], x["block_ord"], x["source"], x["redacted_text"]) for x in r.apply().orderBy("doc_id", "block_ord").collect()]
    assert got == [(1, 1, 0, "native", "plain words of a good page with **********"), (2, 1, 0, "hybrid", "���"), (2, 1, 1, "hybrid", "call **********")]


def _line(k, y0, text_, size=10.0, font="Times-Roman", step=6.0):
    chars = [(c, (10 + i * step, y0, 10 + (i + 1) * step, y0 + 12), 10 + i * step, y0 + 9, font, size, 0) for i, c in enumerate(text_)]
    return (1, 1, k, (10.0, y0, 10 + len(text_) * step, y0 + 12), chars)


LINE_SCHEMA = f"doc_id bigint, page_number int, line_ord int, bbox struct<x0:double,y0:double,x1:double,y1:double>, chars array<{rendering.CHAR}>"
JOB_SCHEMA = "doc_id bigint, page_number int, redaction_type string, replacement_text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def test_drawing(spark):
    # the second line overlaps the first, the third only the second; the fourth stands alone
    lines = spark.createDataFrame([_line(0, 0.0, "ab SECRET cd"), _line(1, 11.0, "next"), _line(2, 22.0, "chained"), _line(3, 60.0, "alone")], LINE_SCHEMA)
    box = (28.0, 1.0, 64.0, 11.0)
    jobs = spark.createDataFrame([(1, 1, "replace", "******", box), (1, 1, "black_bar", "x", (200.0, 200.0, 250.0, 220.0)), (1, 1, "replace", None, (200.0, 300.0, 203.0, 308.0)), (1, 1, "highlight", "alone", (10.0, 60.0, 40.0, 72.0))], JOB_SCHEMA)
    back = spark.createDataFrame([(1, 1, box, 0xEEEEEE)], "doc_id bigint, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, color int")
    ops = rendering.drawing(lines, jobs, back).collect()
    of = lambda step: sorted((r for r in ops if r["step"] == step), key=lambda r: (r["bbox"] or ((),), r["y"] or 0, r["x"] or 0))
    assert [r["bbox"]["y0"] for r in of(1)] == [0.0, 11.0, 22.0] and len(of(2)) == 3
    assert sorted(r["color"] for r in of(3)) == [0, 0xEEEEEE, 0xFFFFFF]
    marks = {r["text"]: r for r in of(4)}
    assert set(marks) == {"******", "*"} and (marks["******"]["font"], marks["******"]["y"], marks["******"]["size"]) == ("tiro", 9.0, 10.0)
    assert (marks["*"]["font"], marks["*"]["size"], marks["*"]["y"]) == ("helv", 6.0, 306.0)
    assert [r["text"] for r in of(5)] == ["ab ", " cd", "next", "chained"] and [r["x"] for r in of(5)][:2] == [10.0, 64.0]
    assert [r["bbox"]["y0"] for r in of(6)] == [60.0]


def test_pieces_break_where_characters_stand_apart(spark):
    k, p, n, b, chars = _line(0, 0.0, "abcd")
    chars[2:] = [(c, (x0 + 5, y0, x1 + 5, y1), x + 5, y, f, s, col) for c, (x0, y0, x1, y1), x, y, f, s, col in chars[2:]]
    df = spark.createDataFrame([(k, p, n, b, chars)], LINE_SCHEMA)
    assert [x["text"] for x in df.select(rendering.pieces(F.col("chars")).alias("p")).first()["p"]] == ["ab", "cd"]


def test_render_and_border(spark):
    import numpy as np

    found = spark.createDataFrame([(1, "a", b"A"), (2, "b", b"B"), (3, "c", b"C")], "doc_id bigint, name string, content binary")
    ops = rendering.drawing(spark.createDataFrame([_line(0, 0.0, "xy")], LINE_SCHEMA), spark.createDataFrame([(1, 1, "replace", "***", (10.0, 0.0, 16.0, 12.0)), (2, 1, "replace", "***", (0.0, 0.0, 9.0, 9.0))], JOB_SCHEMA))

    def draw(name, data, given):
        if name == "b":
            raise ValueError("damaged")
        return data + "".join(o["op"][0] for o in given).encode()

    out = {r["doc_id"]: r for r in rendering.render(found, ops, draw).collect()}
    assert bytes(out[1]["content"]) == b"Arcftt" and bytes(out[3]["content"]) == b"C" and out[2]["content"] is None and "damaged" in out[2]["error"]
    out = {r["doc_id"]: r for r in rendering.render(found, ops, draw, plain=lambda name, data, given: data + b"!").collect()}
    assert bytes(out[2]["content"]) == b"B!"
    img = rendering.page_images(found.filter("doc_id = 1"), lambda name, data, dpi: [(1, 10.0, 20.0, b"png")]).first()
    assert img["scale"] == 2.0 and bytes(img["png"]) == b"png"
    pixels = np.zeros((4, 4, 3), np.uint8)
    pixels[0], pixels[-1], pixels[:, 0], pixels[:, -1] = (1, 2, 3), (1, 2, 3), (1, 2, 3), (9, 9, 9)
    assert rendering.border_color(pixels) == 0x010203 and rendering.border_color(pixels[:2]) == rendering.WHITE


def test_review_rendered(spark):
    b = spark.createDataFrame([(1, 1, 0, "text", "Phone: 9876543210", (10.0, 0.0, 112.0, 12.0))], BLOCKS)
    r = review.Review(b, spark.createDataFrame([(1, "a", "x")], "doc_id bigint, source_path string, source_sha256 string"), registry=registry.default_registry(names=False)).run()
    lines = spark.createDataFrame([_line(0, 0.0, "Phone: 9876543210")], LINE_SCHEMA)
    found = spark.createDataFrame([(1, "a", b"A")], "doc_id bigint, name string, content binary")
    show = lambda name, data, given: "|".join(f"{o['op']} {o['text'] or ''}".strip() for o in given).encode()
    assert bytes(r.rendered(found, lines, show).first()["content"]) == b"remove|clear|fill|text **********|text Phone:"
    assert bytes(r.preview(found, lines, show, lambda name, data, dpi: [(1, 1.0, 1.0, data)]).first()["png"]).startswith(b"remove")


def test_unicode_patterns_and_case(spark):
    one, many = (d.custom("n", "N", [r"\b\d{3}\b"], unicode=u) for u in (False, True))
    assert values(spark, one, "१२३ 123") == ["123"] and values(spark, many, "१२३ 123") == ["१२३", "123"]
    terms = spark.createDataFrame([("Straße", "X", False, None, False)], session.TERMS)
    new = spark.createDataFrame([("STRASSE", "X", False, None, False)], session.TERMS)
    assert [r["term"] for r in session.add_terms(terms, new).collect()] == ["STRASSE"]


def test_expectations(spark):
    dg = spark.createDataFrame([(1, "native", 2, True, False, 0.9), (2, "ocr", 1, False, False, 0.1)], "doc_id bigint, recommendation string, page_count int, has_native_text boolean, is_encrypted boolean, overall_score double")
    want = spark.createDataFrame([(1, "native", 2, True, False, 0.5, 1), (2, "native", 1, True, None, None, 0), (3, None, None, None, None, None, None)], "doc_id bigint, pipeline string, min_pages int, has_text boolean, encrypted boolean, min_quality double, min_elements int")
    out = {r["doc_id"]: r for r in evaluation.expectations_met(dg, spark.createDataFrame([(1,)], "doc_id bigint"), want).collect()}
    assert out[1]["passed"] and out[2]["failures"] == ["pipeline: expected native, got ocr", "text: expected true, got false"] and out[3]["failures"] == ["no diagnostics"]


# --- every query against its SQL ---


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(v) for v in r) for r in df.select(*columns).collect())
    assert got or name in ("metric_regressions",)
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        have = [c[0] for c in cur.description]
        assert sorted(have) == columns
        at = [have.index(c) for c in columns]
        assert got == sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["expectations_met", "document_diagnostics", "text_quality"])
def test_scores_at_a_half_and_near_zero(spark, tmp_path, name):
    """Scores whose fifth place is a 5, and one that Spark writes with an exponent, read as the SQL has them."""
    texts = [" ".join(["ab"] * k + ["abc"] * (w - k)) for w in (80, 160, 320) for k in range(1, w // 2)] + ["a " + "\ufffd" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    cur = con.execute(catalog.ORACLES[name])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert sorted(tuple(_plain(v) for v in r) for r in df.collect()) == sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())


# --- the entry points without the corpus operators ---


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_corpus_operators(tmp_path, also):
    """With both llm folders gone, and the pipeline's file gone or still there, the other queries and their SQL are listed."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("veilspark", "__spark_entry__.py", *(x for x in also if os.path.exists(f"{root}/{x}"))):
        copy = shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy
        copy(f"{root}/{name}", f"{tmp_path}/{name}")
    shutil.rmtree(f"{tmp_path}/veilspark/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(x.startswith('op') or x == 'pipeline' for x in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "True", "False"], out.stderr
