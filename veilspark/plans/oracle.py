"""The engine's stages in DuckDB SQL, as named parts that queries put together."""

from __future__ import annotations

from veilspark.functions import lexicon as lx
from veilspark.functions.checksum import POWERS, PRODUCTS
from veilspark.plans import statements

#: Lines of documents as blocks, laid out as plain text is.
LINES = """l AS (
  SELECT doc_id, (line_no // 53 + 1)::INT AS page_number, line_no::INT AS block_ord, text, 50.0::DOUBLE AS x0, (50.0 + (line_no % 53) * 14.0)::DOUBLE AS y0,
         (50.0 + length(text) * 6.0)::DOUBLE AS x1, (64.0 + (line_no % 53) * 14.0)::DOUBLE AS y1
  FROM (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)) WHERE text <> '')"""


def quoted(xs) -> str:  # noqa: ANN001
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def spans(pattern: str, ord_: int = 0, rel: str = "s") -> str:
    """All matches with offsets: raw, start, "end", pattern_ord and the block's columns."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, page_number, block_ord, block_text, x0, y0, x1, y1, parts[i] AS raw, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0)::INT AS start,
    (coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) + length(parts[i]))::INT AS "end", {ord_} AS pattern_ord
    FROM (SELECT *, unnest(generate_series(2, len(parts), 2)) AS i FROM
    (SELECT doc_id, page_number, block_ord, text AS block_text, x0, y0, x1, y1, string_split(regexp_replace(text, '({p})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM {rel}))"""


NO_SLASH = "NOT ((start > 0 AND substr(block_text, start, 1) = '/') OR substr(block_text, \"end\" + 1, 1) = '/')"
DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
_D = DIGITS.format("raw")
_FREE = "NOT ((start > 0 AND substr(block_text, start, 1) BETWEEN '0' AND '9') OR substr(block_text, \"end\" + 1, 1) BETWEEN '0' AND '9')"
VERHOEFF = f"""list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i: ({POWERS})[((i % 8) * 10 + substr(reverse({_D}), i::INT + 1, 1)::INT) + 1])), lambda c, q: ({PRODUCTS})[c * 10 + q + 1]) = 0"""
_TLD = "string_split({0}, '.')[-1]"
_LONG = "|".join(sorted(lx.TLDS, key=len, reverse=True))


def detection(name: str, kind: str, k: int, rel: str, text: str, confidence: str, reasons: str, where: str, end: str = '"end"') -> str:
    return f"""SELECT doc_id, page_number, block_ord, '{name}' AS detector_name, {k} AS detector_ord, '{kind}' AS detection_type, {text} AS text, start, ({end})::INT AS "end",
    x0, y0, x1, y1, ({confidence})::DOUBLE AS confidence, {reasons} AS reasons, pattern_ord FROM {rel} WHERE {where}"""


def first_of_text(rel: str) -> str:
    return f"SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY page_number, block_ord, pattern_ord, start) AS nth FROM ({rel})) WHERE nth = 1"


def pan(rel: str = "s") -> str:
    return detection("pan", "PAN", 0, f"({spans(lx.PAN, 0, rel)})", "raw", "0.95", "['matches PAN format', 'holder-type code ''' || substr(raw, 4, 1) || ''' is valid']", f"substr(raw, 4, 1) IN ({quoted(lx.PAN_HOLDERS)})")


def aadhaar_raw(rel: str = "s") -> str:
    plain = "[0-9]+"
    return f"SELECT * FROM ({spans('[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}', 0, rel)}) WHERE {_FREE} UNION ALL SELECT * FROM ({spans(plain, 1, rel)}) WHERE length(raw) = 12"


def aadhaar(rel: str = "s", dedupe: bool = True) -> str:
    out = detection("aadhaar", "AADHAAR", 1, f"({aadhaar_raw(rel)})", _D, "0.95", "['matches 12-digit Aadhaar format', 'Verhoeff checksum passed']", f"substr({_D}, 1, 1) NOT IN ('0', '1') AND {NO_SLASH} AND {VERHOEFF}")
    return first_of_text(out) if dedupe else out


def email(rel: str = "s") -> str:
    tld = _TLD.format("raw")
    known = f"regexp_extract({tld}, '^((?i:{_LONG}))\\p{{Lu}}', 1)"
    cut = f"CASE WHEN lower({tld}) IN ({quoted(lx.TLDS)}) OR {known} = '' THEN raw ELSE substr(raw, 1, length(raw) - length({tld}) + length({known})) END"
    sub = f"(SELECT * EXCLUDE (raw), {cut} AS raw FROM ({spans(lx.EMAIL, 0, rel)}))"
    domain = "string_split(raw, '@')[-1]"
    ok = f"length(raw) <= 254 AND length(string_split(raw, '@')[1]) BETWEEN 1 AND 64 AND {domain} NOT LIKE '%..%' AND lower({tld}) IN ({quoted(lx.TLDS)})"
    return detection("email", "EMAIL", 2, sub, "raw", "0.9", "['matches email address format', 'local part and domain are structurally valid']", ok, "start + length(raw)")


def phone_raw(rel: str = "s") -> str:
    rows = " UNION ALL ".join(spans(p.replace("\\b", "\\b"), k, rel) for k, p in enumerate(lx.PHONE))
    conf = f"CASE WHEN length({_D}) = 10 THEN 0.85 WHEN substr(raw, 1, 1) IN ('+', '0') THEN 0.9 ELSE 0.7 END"
    why = f"CASE WHEN length({_D}) = 10 THEN ['10-digit mobile number starting with 6-9'] WHEN substr(raw, 1, 1) = '+' THEN ['matches phone format', 'has international dialling prefix'] WHEN substr(raw, 1, 1) = '0' THEN ['matches phone format', 'has trunk prefix ''0'''] ELSE ['matches phone format'] END"
    return detection("phone", "PHONE", 3, f"({rows})", "raw", conf, why, f"length({_D}) BETWEEN 10 AND 15 AND (length({_D}) <> 10 OR substr({_D}, 1, 1) BETWEEN '6' AND '9') AND {NO_SLASH}")


def phone(rel: str = "s") -> str:
    """Containment fold: lists of one element each, folded in document order."""
    fold = "list_reduce(list_transform(xs, lambda v: [v]), lambda a, x: CASE WHEN len(list_filter(a, lambda e: contains(e.d, x[1].d) OR contains(x[1].d, e.d))) > 0 THEN a ELSE list_concat(a, x) END)"
    rows = f"SELECT list({{'d': {DIGITS.format('text')}, 'r': p}} ORDER BY page_number, block_ord, pattern_ord, start) AS xs FROM ({phone_raw(rel)}) p GROUP BY doc_id"
    return f"SELECT unnest(v.r) FROM (SELECT unnest({fold}) AS v FROM ({rows}))"


def upi(rel: str = "s") -> str:
    handle = "string_split(raw, '@')[2]"
    why = f"['matches UPI ID format', CASE WHEN {handle} IN ({quoted(lx.UPI_HANDLES)}) THEN 'known payment-provider handle ''' ELSE 'unrecognised handle ''' END || {handle} || '''']"
    return first_of_text(detection("upi", "UPI", 4, f"({spans(lx.UPI, 0, rel)})", "raw", f"CASE WHEN {handle} IN ({quoted(lx.UPI_HANDLES)}) THEN 0.95 ELSE 0.7 END", why, f"length(raw) <= 50 AND raw NOT LIKE '%..%' AND {handle} NOT LIKE '%.%'"))


def ifsc(rel: str = "s") -> str:
    why = f"CASE WHEN substr(raw, 1, 4) IN ({quoted(lx.BANK_CODES)}) THEN ['matches IFSC format (bank code + ''0'' + branch code)', 'recognised bank code ''' || substr(raw, 1, 4) || ''''] ELSE ['matches IFSC format (bank code + ''0'' + branch code)'] END"
    return first_of_text(detection("ifsc", "IFSC", 5, f"({spans(lx.IFSC, 0, rel)})", "raw", "0.95", why, "true"))


_LABEL = lx.LABEL_AT_END.replace("'", "''")


def account(rel: str = "s", only: int | None = None, dedupe: bool = True) -> str:
    labelled = f"(SELECT *, coalesce(regexp_matches(lag(text) OVER (PARTITION BY doc_id, page_number ORDER BY block_ord), '{_LABEL}'), false) AS labelled FROM {rel})"
    by_label = f"""SELECT * EXCLUDE (raw, start, "end", num), num AS raw, "end" AS start, "end" + length(num) AS "end" FROM (SELECT *, regexp_extract(substr(block_text, "end" + 1), '^[0-9]{{9,18}}') AS num FROM ({spans(lx.ACCOUNT_LABEL, 0, rel)})) WHERE num <> ''"""
    alone = f"""SELECT * FROM ({spans(lx.ACCOUNT_ALONE, 1, rel)}) WHERE NOT regexp_matches(substr(block_text, greatest(start - 14, 1), least(start, 15)), '[A-Za-z]{{4}}0')"""
    rows = f"SELECT m.*, b.labelled FROM ({by_label} UNION ALL BY NAME {alone}) m JOIN {labelled} b USING (doc_id, page_number, block_ord)"
    ok = """length(raw) BETWEEN 9 AND 18 AND length(replace(raw, substr(raw, 1, 1), '')) > 0 AND NOT (length(raw) = 10 AND substr(raw, 1, 1) BETWEEN '6' AND '9') AND length(raw) <> 12
    AND NOT (length(raw) >= 10 AND length(raw) - length(replace(raw, '0', '')) > length(raw) * 0.7::DOUBLE) AND NOT regexp_matches(substr(block_text, "end" + 1), '(?i)^\\s*AT\\s*[0-9]{5}\\b')"""
    why = "CASE WHEN pattern_ord = 0 THEN ['9-18 digit number', 'follows an account label (e.g. ''A/c No'')'] WHEN labelled THEN ['standalone number of common account length (11-15 digits)', 'previous block ends with an account label'] ELSE ['standalone number of common account length (11-15 digits)'] END"
    out = detection("account", "ACCOUNT", 6, f"({rows})", "raw", "CASE WHEN pattern_ord = 0 OR labelled THEN 0.85 ELSE 0.7 END", why, f"{ok} AND {NO_SLASH}")
    out = first_of_text(out) if dedupe else out
    return out if only is None else f"SELECT * FROM ({out}) WHERE pattern_ord = {only}"


#: All seven pattern detectors over the statements.
ALL = "d AS (" + " UNION ALL BY NAME ".join(f"SELECT * FROM ({f()})" for f in (pan, aadhaar, email, phone, upi, ifsc, account)) + ")"


def _terms(kind: str, which: int, text: str) -> str:
    import re

    word = lambda t: "(?i)(?:^|[^a-z0-9])" + re.sub(r"([^\w\s])", r"\\\1", t) + "(?:$|[^a-z0-9])"
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({text}, '{word(t)}') THEN '{t}' END" for t in lx.CONTEXT_TERMS[kind][which]) + ")"


def _by_type(which: int, text: str) -> str:
    return "CASE detection_type " + " ".join(f"WHEN '{k}' THEN {_terms(k, which, text)}" for k in lx.CONTEXT_TERMS) + " END"


#: Context scores: the statements' blocks have no newline, so the line is the block.
CONTEXT = f"""n AS (SELECT doc_id, page_number, block_ord, text AS at_text, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM s WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY block_ord)),
t0 AS (SELECT d.*, at_text, concat_ws(chr(10), substr(at_text, 1, start) || substr(at_text, "end" + 1), prev_text, next_text) AS near FROM d JOIN n USING (doc_id, page_number, block_ord)),
t1 AS (SELECT *, {_by_type(0, 'at_text')} AS lp, {_by_type(1, 'at_text')} AS ln, {_by_type(0, 'near')} AS np, {_by_type(1, 'near')} AS nn FROM t0),
t2 AS (SELECT *, CASE WHEN lp IS NOT NULL THEN 0.10::DOUBLE WHEN ln IS NOT NULL AND detection_type = 'PHONE' AND substr(text, 1, 1) NOT IN ('+', '0') THEN -confidence
  WHEN ln IS NOT NULL THEN -0.35::DOUBLE WHEN np IS NOT NULL THEN 0.05::DOUBLE WHEN nn IS NOT NULL THEN -0.20::DOUBLE END AS delta,
  CASE WHEN lp IS NOT NULL THEN 'near label ''' || lp || '''' WHEN ln IS NOT NULL AND detection_type = 'PHONE' AND substr(text, 1, 1) NOT IN ('+', '0') THEN 'bare number in reference context (''' || ln || ''') — dropped'
  WHEN ln IS NOT NULL THEN 'reference context on the same line (''' || ln || ''')' WHEN np IS NOT NULL THEN 'label ''' || np || ''' in surrounding text' WHEN nn IS NOT NULL THEN 'reference context in surrounding text (''' || nn || ''')' END AS why FROM t1),
x AS (SELECT * REPLACE (CASE WHEN delta IS NULL THEN confidence ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence + delta)) END AS confidence, CASE WHEN why IS NULL THEN reasons ELSE list_append(reasons, why) END AS reasons),
  coalesce(delta < 0 AND greatest(0.0::DOUBLE, confidence + delta) < 0.3::DOUBLE, false) AS dropped FROM t2),
c AS (SELECT * FROM x WHERE NOT dropped)"""

_PRIO = "CASE WHEN detector_name IN ('pan', 'aadhaar', 'email', 'phone', 'upi') THEN 5 ELSE 3 END"


def fused(rel: str) -> str:
    """Ordered fold over (document, page, type): kept detections; reasons of the losers are appended."""
    a, b = "a[len(a)]", "x[1]"
    inter = f"(greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"
    area = lambda v: f"(({v}.x1 - {v}.x0) * ({v}.y1 - {v}.y0))"
    hit = f'({a}.start < {b}."end" AND {b}.start < {a}."end" AND {inter} / ({area(a)} + {area(b)} - {inter}) > 0.5)'
    a_wins = f"({a}.prio > {b}.prio OR ({a}.prio = {b}.prio AND {a}.confidence >= {b}.confidence))"
    more = lambda w, v: f"struct_update({w}, reasons := list_concat({w}.reasons, list_filter({v}.reasons, lambda r: NOT list_contains({w}.reasons, r))))"
    fold = f"list_reduce(list_transform(xs, lambda v: [v]), lambda a, x: CASE WHEN NOT {hit} THEN list_concat(a, x) WHEN {a_wins} THEN list_append(a[1:len(a) - 1], {more(a, b)}) ELSE list_append(a[1:len(a) - 1], {more(b, a)}) END)"
    cols = ["doc_id", "page_number", "block_ord", "detector_name", "detector_ord", "detection_type", "text", "start", '"end"', "x0", "y0", "x1", "y1", "confidence", "reasons", "pattern_ord"]
    pack = "{" + ", ".join(f"'{c.strip(chr(34))}': {c}" for c in cols) + f", 'prio': {_PRIO}" + "}"
    return f"""SELECT unnest(v) FROM (SELECT unnest({fold}) AS v FROM (SELECT list({pack} ORDER BY start, -({_PRIO}), -confidence, detector_ord, block_ord, pattern_ord) AS xs FROM {rel} GROUP BY doc_id, page_number, detection_type))"""


FUSED = f"f AS ({fused('c')})"


def _two(x: str) -> str:
    return f"printf('%.2f', {x})"


def suggested(rel: str, name: str, default: str = "redact", keep: tuple[str, ...] = ()) -> str:
    act = f"CASE WHEN detection_type IN ({quoted(keep)}) THEN 'keep' ELSE '{default}' END" if keep else f"'{default}'"
    return f"""SELECT *, CASE WHEN act = 'keep' THEN 'keep' WHEN act = 'ask' THEN 'ask' WHEN confidence >= 0.9::DOUBLE THEN 'redact' WHEN confidence >= 0.5::DOUBLE THEN 'ask' ELSE 'keep' END AS suggested_action,
    CASE WHEN act = 'keep' THEN 'policy ''{name}'' keeps ' || detection_type WHEN act = 'ask' THEN 'policy ''{name}'' defers ' || detection_type || ' to review'
    WHEN confidence >= 0.9::DOUBLE THEN 'confidence ' || {_two('confidence')} || ' >= auto-redact threshold 0.90' WHEN confidence >= 0.5::DOUBLE THEN 'confidence ' || {_two('confidence')} || ' in the ask band [0.50, 0.90)'
    ELSE 'confidence ' || {_two('confidence')} || ' below the ask threshold 0.50 (probable noise)' END AS suggestion_reason,
    (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, start, detection_type, block_ord, detector_ord, pattern_ord) - 1)::INT AS entry_ord FROM (SELECT *, {act} AS act FROM {rel})"""


DETECTION_ID = """substr(sha256(page_number || '|' || detection_type || '|' || start || '|' || "end" || '|' || text), 1, 12)"""
WITH = f"WITH {statements.SQL}"
THROUGH_CONTEXT = f"{WITH}, {ALL}, {CONTEXT}"
THROUGH_FUSION = f"{THROUGH_CONTEXT}, {FUSED}"
