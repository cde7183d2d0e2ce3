"""Registry of the engine's queries and of the SQL that gives the same rows.

Queries on statements (``S``) read the customer table, queries on lines (``L``) the documents. Every query returns scalar
columns; reasons are joined by "; ".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions import geometry as g
from veilspark.functions.spans import spans_of
from veilspark.operators import banks, context, decision, evaluation, fusion, hybrid, layout, names, quality, redaction, registry, rendering, review, session, text_layer
from veilspark.operators import detectors as d
from veilspark.plans import oracle as o
from veilspark.plans import statements
from veilspark.sources import files, plans, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- inputs ---------------------------------------------------------------------------------------------------------


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def S(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return statements.blocks(spark, sf_dir)


def L(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return text.line_blocks(docs(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven pattern detectors over the statements."""
    return registry.default_registry(names=False).run(S(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.apply(found(spark, sf_dir), S(spark, sf_dir))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(scored(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str, policy: str = decision.DEFAULT) -> DataFrame:
    return decision.suggest(registry.with_ids(fused(spark, sf_dir)), decision.get_policy(policy))


def flat(df: DataFrame) -> DataFrame:
    out = df
    if "bbox" in out.columns:
        out = out.drop("bbox")
    for c, t in out.dtypes:
        if t == "array<string>":
            out = out.withColumn(c, F.array_join(c, "; "))
    return out


def _flat_sql(with_: str, rel: str, extra: str = "") -> str:
    return f"{with_} SELECT * EXCLUDE (x0, y0, x1, y1{extra}) REPLACE (array_to_string(reasons, '; ') AS reasons) FROM {rel}"


def _one(sql: str) -> str:
    return _flat_sql(f"{o.WITH}, q AS ({sql})", "q")


# --- sources --------------------------------------------------------------------------------------------------------


@query(f"WITH {o.LINES} SELECT doc_id, page_number, block_ord, text, y0, x1 FROM l")
def blocks_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L(spark, sf_dir).select("doc_id", "page_number", "block_ord", "text", F.col("bbox.y0").alias("y0"), F.col("bbox.x1").alias("x1"))


@query(f"WITH {o.LINES} SELECT doc_id, page_number, count(*)::BIGINT AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM l GROUP BY ALL")
def paginate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
#: A line loses its first 82 characters, or what goes before the last blank among 83, and the blanks after them, until it fits.
_WRAPPED = f"""WITH RECURSIVE t AS (SELECT doc_id, string_split_regex(replace(coalesce(text, ''), chr(9), '    '), '{_BREAKS}') AS xs FROM documents),
lines AS (SELECT doc_id, generate_subscripts(xs, 1) AS line, unnest(xs) AS rest FROM t),
w AS (SELECT doc_id, line, 0 AS part, NULL::VARCHAR AS done, rest FROM lines UNION ALL
  SELECT doc_id, line, part + 1, CASE WHEN length(rest) <= 82 THEN rest ELSE substr(rest, 1, upto) END, CASE WHEN length(rest) > 82 THEN ltrim(substr(rest, upto + 1), ' ') END
  FROM (SELECT *, coalesce(nullif(length(regexp_extract(substr(rest, 1, 83), '(?s)^(.*) [^ ]*$', 1)), 0), 82) AS upto FROM w WHERE rest IS NOT NULL)),
n AS (SELECT doc_id, done AS text, (row_number() OVER (PARTITION BY doc_id ORDER BY line, part) - 1)::INT AS block_ord FROM w WHERE part > 0)
SELECT doc_id, (block_ord // 53 + 1)::INT AS page_number, block_ord, text FROM n WHERE text <> ''"""


@query(_WRAPPED)
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.wrapped_blocks(docs(spark, sf_dir)).select("doc_id", "page_number", "block_ord", "text")


@query("SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), chr(10)) AS full_text FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\\n]')")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.full_text(L(spark, sf_dir)).select("doc_id", F.col("text").alias("full_text"))


@query(f"{o.WITH} SELECT doc_id, page_number, 'text' AS block_type, x0, y0, x1, y1, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS preview FROM s")
def scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S(spark, sf_dir).select("doc_id", "page_number", "block_type", "bbox.*", text.preview(F.col("text")).alias("preview"))


_NAMES = "SELECT s_suppkey AS ord, CASE s_suppkey % 6 WHEN 0 THEN 'Report ' || s_suppkey || '.DOCX' WHEN 1 THEN 'scan_' || s_suppkey || '.png' WHEN 2 THEN 'scan_' || (s_suppkey - 1) || '.pdf' WHEN 3 THEN 'old.redacted.pdf' WHEN 4 THEN 'notes?' || s_suppkey || '.tar.gz' ELSE 'Bill (a).pdf' END AS name FROM supplier"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("veilspark_supplier")
    return spark.sql(_NAMES.replace("FROM supplier", "FROM veilspark_supplier").replace("|| s_suppkey", "|| CAST(s_suppkey AS STRING)").replace("(s_suppkey - 1)", "CAST(s_suppkey - 1 AS STRING)"))


@query(
    f"""WITH f AS ({_NAMES}), k AS (SELECT * FROM f WHERE regexp_matches(lower(name), '\\.(pdf|png|jpg|jpeg|tif|tiff|bmp|webp|gif|txt|md|docx)$') AND NOT lower(name) LIKE '%.redacted.pdf')
    SELECT ord, name FROM k WHERE name NOT IN (SELECT regexp_replace(name, '\\.[^./]+$', '') || '.pdf' FROM k WHERE NOT lower(name) LIKE '%.pdf')"""
)
def workspace_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.workspace(_names(spark, sf_dir)).select("ord", "name")


@query(
    f"""WITH f AS ({_NAMES}), n AS (SELECT *, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS suffix, regexp_replace(name, '\\.[^./]+$', '') AS stem, row_number() OVER (PARTITION BY name ORDER BY ord) AS nth FROM f)
    SELECT ord, name, lower(regexp_replace(regexp_replace(stem, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, regexp_replace(stem, '[^a-zA-Z0-9._-]', '_', 'g') || suffix AS safe_name,
    CASE WHEN nth = 1 THEN name ELSE stem || '-' || nth || regexp_extract(name, '(\\.[^./]+)$', 1) END AS unique_name,
    CASE WHEN suffix = '.pdf' THEN 'pdf' WHEN suffix = '.png' THEN 'image' WHEN suffix = '.docx' THEN 'docx' END AS kind FROM n"""
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = files.unique_names(_names(spark, sf_dir))
    return named.select("ord", "name", files.slug(F.col("name")).alias("slug"), files.safe_name(F.col("name")).alias("safe_name"), "unique_name", files.kind(F.col("name")).alias("kind"))


@query(
    f"""WITH f AS ({_NAMES}) SELECT ord, CASE WHEN NOT regexp_matches(lower(name), '\\.(pdf|png|docx)$') THEN 'unsupported file type' WHEN ord % 7 = 0 THEN 'empty file' WHEN lower(name) LIKE '%.pdf' AND ord % 5 <> 0 THEN 'not a PDF' END AS refused FROM f"""
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("ord") % 7 == 0, "").when(F.col("ord") % 5 == 0, "%PDF-1.7 ...").otherwise("GIF89a").cast("binary")
    return _names(spark, sf_dir).select("ord", files.upload_error(F.col("name"), content).alias("refused"))


@query(
    f"""{o.WITH}, w AS (SELECT doc_id, page_number, block_ord, parts[i] AS word, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS st, text, x0, x1 FROM (SELECT *, unnest(generate_series(2, len(parts), 2)) AS i FROM
    (SELECT *, string_split(regexp_replace(text, '(\\S+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM s)))
    SELECT doc_id, page_number, block_ord, word, round(x0 + st * ((x1 - x0) / length(text)), 6) AS x0, round(x0 + (st + length(word)) * ((x1 - x0) / length(text)), 6) AS x1 FROM w"""
)
def words_with_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S(spark, sf_dir).select("doc_id", "page_number", "block_ord", F.explode(g.words_with_boxes(F.col("text"), F.col("bbox"))).alias("w"))
    return w.select("doc_id", "page_number", "block_ord", F.col("w.text").alias("word"), F.round("w.bbox.x0", 6).alias("x0"), F.round("w.bbox.x1", 6).alias("x1"))


def _with_words(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("words", g.words_with_boxes(F.col("text"), F.col("bbox")))


@query(f"""{o.WITH}, q AS ({o.email()}) SELECT doc_id, page_number, block_ord, text, round(x0 + start * 6.0, 6) AS x0, y0, round(x0 + "end" * 6.0, 6) AS x1, y1 FROM q""")
def bbox_for_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.scan(_with_words(S(spark, sf_dir)), d.EMAIL, values_only=True)
    return rows.select("doc_id", "page_number", "block_ord", "text", F.round("bbox.x0", 6).alias("x0"), F.col("bbox.y0").alias("y0"), F.round("bbox.x1", 6).alias("x1"), F.col("bbox.y1").alias("y1"))


@query(f"{o.WITH} SELECT doc_id, page_number, block_ord, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::BIGINT AS n_words, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::BIGINT AS n_kept FROM s")
def dedupe_twin_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word stands twice, the second time moved by a tenth of a point: the twins go."""
    w = F.col("words")
    twice = F.concat(w, F.transform(w, lambda x: F.struct(x["text"].alias("text"), g.box(x["bbox"]["x0"] + 0.1, x["bbox"]["y0"], x["bbox"]["x1"] + 0.1, x["bbox"]["y1"]).alias("bbox"))))
    return _with_words(S(spark, sf_dir)).select("doc_id", "page_number", "block_ord", F.size(w).cast("bigint").alias("n_words"), F.size(g.without_twins(twice)).cast("bigint").alias("n_kept"))


def _chars(blocks: DataFrame) -> DataFrame:
    """A character a row, half a point to the right of where its share of the block's box begins."""
    i = F.posexplode(F.split("text", "")).alias("char_ord", "char")
    x0 = F.col("bbox.x0") + 0.5 + F.col("char_ord") * 6.0
    return blocks.select("doc_id", "page_number", F.col("block_ord").alias("run"), "bbox", i).withColumn("bbox", g.box(x0, F.col("bbox.y0"), x0 + 6.0, F.col("bbox.y1")))


@query(
    f"""{o.WITH}, w AS (SELECT doc_id, page_number, block_ord, parts[i] AS word, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS st FROM (SELECT *, unnest(generate_series(2, len(parts), 2)) AS i FROM
    (SELECT *, string_split(regexp_replace(text, '(\\S+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM s)))
    SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_ord, st) - 1)::INT AS word_ord, word, CASE WHEN block_ord % 2 = 1 THEN length(word)::INT + 1 END AS n_edges,
    CASE WHEN block_ord % 2 = 1 THEN round(50.5 + st * 6.0, 6)::DOUBLE END AS first_edge, CASE WHEN block_ord % 2 = 1 THEN round(50.5 + (st + length(word)) * 6.0, 6)::DOUBLE END AS last_edge FROM w"""
)
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each page; those of every second block with the edges of their characters."""
    s = S(spark, sf_dir)
    w = text_layer.page_words(text_layer.with_edges(_with_words(s), text_layer.glyph_words(_chars(s.filter("block_ord % 2 = 1")))))
    n = F.when(F.col("edges").isNotNull(), F.size("edges"))
    return w.select("doc_id", "page_number", "word_ord", F.col("text").alias("word"), n.alias("n_edges"), F.round(F.get("edges", F.lit(0)), 6).alias("first_edge"), F.round(F.get("edges", n - 1), 6).alias("last_edge"))


@query(f"{o.WITH} SELECT doc_id, page_number, block_ord, text FROM s")
def blocks_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _with_words(S(spark, sf_dir))
    words = b.select("doc_id", "page_number", F.explode("words").alias("w")).select("doc_id", "page_number", "w.*")
    return text.blocks_from_words(b.select("doc_id", "page_number", "block_ord", "bbox"), words).select("doc_id", "page_number", "block_ord", "text")


@query(f"{o.WITH} SELECT doc_id, page_number, block_ord, x0 * 2.0 AS x0, y0 * 2.0 AS y0, x1 * 2.0 AS x1, y1 * 2.0 AS y1 FROM s")
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S(spark, sf_dir).select("doc_id", "page_number", "block_ord", g.to_pixels(F.col("bbox")).alias("p")).select("doc_id", "page_number", "block_ord", "p.*")


@query(
    f"""{o.WITH}, n AS (SELECT *, lead(x1) OVER w AS bx1, lead(y0) OVER w AS by0, lead(y1) OVER w AS by1 FROM (SELECT * REPLACE (y1 + 4.0 AS y1) FROM s) WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY block_ord)),
    i AS (SELECT *, greatest(0.0, least(x1, bx1) - 50.0) * greatest(0.0, least(y1, by1) - greatest(y0, by0)) AS shared FROM n WHERE bx1 IS NOT NULL)
    SELECT doc_id, page_number, block_ord, NOT (y1 < by0 OR by1 < y0) AS touching, round(shared / ((x1 - 50.0) * (y1 - y0) + (bx1 - 50.0) * (by1 - by0) - shared), 9) AS iou FROM i"""
)
def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block, made four points taller, against the next one on its page."""
    tall = S(spark, sf_dir).withColumn("bbox", g.box(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1"), F.col("bbox.y1") + 4.0))
    pair = tall.withColumn("b", F.lead("bbox").over(Window.partitionBy("doc_id", "page_number").orderBy("block_ord"))).filter("b is not null")
    return pair.select("doc_id", "page_number", "block_ord", g.touch(F.col("bbox"), F.col("b")).alias("touching"), F.round(g.iou(F.col("bbox"), F.col("b")), 9).alias("iou"))


@query(
    f"""{o.WITH}, w AS (SELECT doc_id, page_number, block_ord, parts[i] AS word, 50.0 + coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) * 6.0 AS wx, y0, y1 FROM (SELECT *, unnest(generate_series(2, len(parts), 2)) AS i FROM
    (SELECT *, string_split(regexp_replace(text, '(\\S+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM s))),
    c AS (SELECT *, greatest(0, floor((80.0 - wx) / (length(word) * 6.0) * length(word) + 0.5))::INT AS sel_from, least(length(word), floor((161.0 - wx) / (length(word) * 6.0) * length(word) + 0.5))::INT AS sel_to FROM w WHERE wx < 161.0 AND wx + length(word) * 6.0 > 80.0 AND y0 < 205.0 AND y1 > 110.0)
    SELECT doc_id, page_number, block_ord, word, sel_from, sel_to FROM c WHERE sel_to > sel_from"""
)
def drag_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that a rectangle dragged over each page selects."""
    w = S(spark, sf_dir).select("doc_id", "page_number", "block_ord", F.explode(g.words_with_boxes(F.col("text"), F.col("bbox"))).alias("w")).select("doc_id", "page_number", "block_ord", "w.*")
    picked = session.select_chars(w, F.lit(80.0), F.lit(110.0), F.lit(161.0), F.lit(205.0))
    return picked.select("doc_id", "page_number", "block_ord", F.col("text").alias("word"), "sel_from", "sel_to")


# --- detectors ------------------------------------------------------------------------------------------------------


@query(_flat_sql(f"WITH {o.LINES}, q AS ({o.email('l')})", "q"))
def detect_email_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.scan(L(spark, sf_dir), d.EMAIL, 2))


@query(
    f"""WITH {o.LINES}, q AS ({o.email('l')}), r AS (SELECT doc_id, block_ord, string_agg(gap || stars, '' ORDER BY start) AS head, max("end") AS last, count(*)::BIGINT AS n_redactions FROM
    (SELECT q.*, substr(l.text, coalesce(lag("end") OVER w, 0) + 1, start - coalesce(lag("end") OVER w, 0)) AS gap, repeat('*', greatest(3, least(length(q.text), 32))) AS stars FROM q JOIN l USING (doc_id, block_ord) WINDOW w AS (PARTITION BY doc_id, block_ord ORDER BY start)) GROUP BY doc_id, block_ord)
    SELECT doc_id, l.page_number, block_ord, head || substr(l.text, last + 1) AS redacted_text, n_redactions FROM r JOIN l USING (doc_id, block_ord)"""
)
def redacted_email_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold an address, redacted: source, scan, policy, plan and text in one pass."""
    b = L(spark, sf_dir).filter(F.col("text").contains("@"))
    hits = decision.suggest(d.scan(b, d.EMAIL, 2), decision.get_policy())
    out = redaction.redacted_blocks(b, redaction.plan(decision.resolve(hits, accept_suggestions=True))).filter("n_redactions > 0")
    return out.select("doc_id", "page_number", "block_ord", "redacted_text", "n_redactions")


def _detector(name: str, det: d.Detector, k: int, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(d.scan(S(spark, sf_dir), det, k))

    run.__name__ = name
    query(_one(sql))(run)


_detector("detect_pan", d.PAN, 0, o.pan())
_detector("detect_aadhaar", d.AADHAAR, 1, o.aadhaar())
_detector("detect_email", d.EMAIL, 2, o.email())
_detector("detect_phone", d.PHONE, 3, o.phone())
_detector("detect_upi", d.UPI, 4, o.upi())
_detector("detect_ifsc", d.IFSC, 5, o.ifsc())
_detector("detect_account", d.ACCOUNT, 6, o.account())


@query(f"{o.WITH} SELECT doc_id, page_number, block_ord, raw, start, \"end\", pattern_ord FROM ({o.aadhaar_raw()})")
def aadhaar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S(spark, sf_dir)
    rows = [b.select("doc_id", "page_number", "block_ord", F.explode(spans_of(F.col("text"), p)).alias("s"), F.lit(k).alias("pattern_ord")) for k, p in enumerate(d.AADHAAR.patterns)]
    return rows[0].unionByName(rows[1]).select("doc_id", "page_number", "block_ord", F.col("s.value").alias("raw"), "s.start", "s.end", "pattern_ord")


@query(_one(o.account(only=0, dedupe=False)))
def detect_account_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.scan(S(spark, sf_dir), d.ACCOUNT, 6, dedupe="none").filter("pattern_ord = 0"))


@query(_one(o.account(only=1, dedupe=False)))
def detect_account_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.scan(S(spark, sf_dir), d.ACCOUNT, 6, dedupe="none").filter("pattern_ord = 1"))


@query(_flat_sql(f"{o.WITH}, q AS ({o.account()})", "q WHERE array_to_string(reasons, ';') LIKE '%previous block%'"))
def account_cross_block_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.scan(S(spark, sf_dir), d.ACCOUNT, 6)).filter(F.col("reasons").contains("previous block"))


@query(_one(o.phone_raw()))
def detect_phone_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(d.scan(S(spark, sf_dir), d.PHONE, 3, dedupe="none"))


@query(f"""WITH {o.LINES} SELECT doc_id, block_ord, raw AS text, start, "end", 0.8::DOUBLE AS confidence FROM ({o.spans('[0-9]{5}', 0, 'l')}) WHERE raw <> '00000'""")
def detect_regex_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = d.custom("five", "CODE", ["[0-9]{5}"], confidence=lambda raw, *_: F.when(raw != "00000", 0.8))
    return d.scan(L(spark, sf_dir), own).select("doc_id", "block_ord", "text", "start", "end", "confidence")


@query(
    f"""{o.WITH}, m0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '([a-zA-Z0-9._%+-]+)@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', 1)) AS local FROM s),
    m AS (SELECT doc_id, unnest(string_split_regex(string_split(local, '+')[1], '[._%0-9-]+')) AS token, 'email' AS source FROM m0),
    h0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:linkedin\\.com/in/|github\\.com/)([A-Za-z0-9_-]{{3,}})', 1)) AS handle FROM s),
    h AS (SELECT doc_id, unnest(regexp_extract_all(handle, '[A-Z][a-z]{{2,}}')) AS token, 'handle' AS source FROM h0)
    SELECT DISTINCT doc_id, lower(token) AS token, source FROM (SELECT * FROM m UNION ALL SELECT * FROM h) WHERE length(token) >= 4 AND regexp_full_match(token, '\\p{{L}}+') AND lower(token) NOT IN ({o.quoted(names.lx.NOT_NAMES)})"""
)
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.candidates(S(spark, sf_dir))


_USABLE = f"length(token) >= 4 AND regexp_full_match(token, '\\p{{L}}+') AND token NOT IN ({o.quoted(names.lx.NOT_NAMES)})"
#: Tokens with the address (m), camel-case handle (cm), whole handle (ow) and title line (ti) that speak for them.
_NAME_EVIDENCE = f"""m0 AS (SELECT doc_id, page_number * 1000000000 + block_ord * 1000 + generate_subscripts(xs, 1) AS pl, string_split(unnest(xs), '+')[1] AS raw FROM (SELECT *, regexp_extract_all(text, '{names.lx.EMAIL_LOCAL}', 1) AS xs FROM s)),
m AS (SELECT doc_id, token, arg_min(raw, pl) AS mail FROM (SELECT doc_id, pl, raw, lower(unnest(string_split_regex(raw, '[._%0-9-]+'))) AS token FROM m0) WHERE {_USABLE} GROUP BY ALL),
h0 AS (SELECT doc_id, page_number * 1000000000 + block_ord * 1000 + generate_subscripts(xs, 1) AS pl, unnest(xs) AS raw FROM (SELECT *, regexp_extract_all(text, '(?i){names.lx.PROFILE}', 1) AS xs FROM s)),
cm AS (SELECT doc_id, token, arg_min(raw, pl) AS camel FROM (SELECT doc_id, pl, raw, lower(unnest(regexp_extract_all(raw, '[A-Z][a-z]{{2,}}'))) AS token FROM h0) WHERE {_USABLE} GROUP BY ALL),
sl AS (SELECT doc_id, lower(raw) AS slug, min(pl) AS pl, arg_min(raw, pl) AS raw FROM h0 GROUP BY ALL),
ow AS (SELECT doc_id, token, pl AS own_at, raw AS own FROM (SELECT *, slug AS token FROM sl) WHERE {_USABLE}),
ins AS (SELECT sl.doc_id, slug, token, pl, raw FROM sl JOIN m ON sl.doc_id = m.doc_id AND contains(slug, token) AND slug <> token),
he AS (SELECT doc_id, token, min(pl) AS held_at, arg_min(raw, pl) AS held FROM ins GROUP BY ALL),
le AS (SELECT doc_id, slug AS token, min(token) AS lent FROM ins GROUP BY ALL),
tp AS (SELECT *, first_value(page_number) OVER w AS page0, row_number() OVER w AS nth, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS line FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, block_ord)),
tl AS (SELECT doc_id, arg_min(line, nth) AS line FROM tp WHERE nth <= 3 AND page_number = page0 AND length(line) <= 40 AND regexp_full_match(line, '\\p{{Lu}}\\p{{L}}*(\\s+\\p{{Lu}}\\p{{L}}*){{1,3}}') GROUP BY doc_id),
ti AS (SELECT DISTINCT doc_id, token, line FROM (SELECT doc_id, line, lower(unnest(string_split_regex(line, '\\s+'))) AS token FROM tl) WHERE {_USABLE}),
tk AS (SELECT * FROM m FULL JOIN cm USING (doc_id, token) FULL JOIN ow USING (doc_id, token) LEFT JOIN he USING (doc_id, token) LEFT JOIN le USING (doc_id, token) LEFT JOIN ti USING (doc_id, token)),
tr AS (SELECT *, CASE WHEN camel IS NOT NULL THEN 'derived from profile handle ''' || camel || '''' WHEN own IS NOT NULL AND (held_at IS NULL OR own_at < held_at) THEN 'profile handle ''' || own || '''' WHEN held IS NOT NULL THEN 'contained in profile handle ''' || held || '''' END AS by_handle FROM tk),
live AS (SELECT doc_id, token, list_filter([CASE WHEN mail IS NOT NULL THEN 'derived from email local part ''' || mail || '''' ELSE by_handle END, CASE WHEN mail IS NOT NULL THEN by_handle WHEN own IS NOT NULL THEN 'contains email-derived token ''' || lent || '''' END, 'appears in the title line ''' || line || ''''], lambda x: x IS NOT NULL) AS reasons FROM tr)"""
#: Places of the tokens in a block: between non-letters or camel-case edges, none within a longer one.
_NAMES_FOUND = f"""{o.WITH}, {_NAME_EVIDENCE},
sp AS (SELECT doc_id, page_number, block_ord, text, token, reasons, string_split(lower(text), token) AS ps FROM s JOIN live USING (doc_id) WHERE contains(lower(text), token)),
at0 AS (SELECT *, unnest(range(1, len(ps))) AS k FROM sp),
at1 AS (SELECT *, (list_sum(list_transform(ps[1:k], lambda x: length(x))) + (k - 1) * length(token))::INT AS start FROM at0),
at2 AS (SELECT *, (start + length(token))::INT AS stop, CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END AS lc, substr(text, start + 1, 1) AS fc, substr(text, start + length(token)::INT, 1) AS ec, substr(text, start + length(token)::INT + 1, 1) AS rc FROM at1),
fr AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, page_number, block_ord ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM at2
  WHERE (NOT regexp_full_match(lc, '\\p{{L}}') OR (regexp_full_match(lc, '\\p{{Ll}}') AND regexp_full_match(fc, '\\p{{Lu}}'))) AND (NOT regexp_full_match(rc, '\\p{{L}}') OR (regexp_full_match(ec, '\\p{{Ll}}') AND regexp_full_match(rc, '\\p{{Lu}}'))))
SELECT doc_id, page_number, block_ord, 'name' AS detector_name, 7 AS detector_ord, 'NAME' AS detection_type, substr(text, start + 1, length(token)) AS text, start, stop AS "end", CASE WHEN len(reasons) > 1 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence, array_to_string(reasons, '; ') AS reasons, 0 AS pattern_ord
FROM fr WHERE reach IS NULL OR reach < stop"""


@query(_NAMES_FOUND)
def detect_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(names.scan_names(S(spark, sf_dir)))


@query(_flat_sql(f"{o.WITH}, {o.ALL}", "d"))
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(found(spark, sf_dir))


@query(f"{o.WITH}, {o.ALL} SELECT detector_name, count(*)::BIGINT AS n_detections FROM d GROUP BY detector_name")
def detector_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.run_counts(found(spark, sf_dir))


@query(f'{o.WITH}, {o.ALL} SELECT doc_id, page_number, block_ord, detection_type, start, "end", text, {o.DETECTION_ID} AS detection_id FROM d')
def detection_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.with_ids(found(spark, sf_dir)).select("doc_id", "page_number", "block_ord", "detection_type", "start", "end", "text", "detection_id")


# --- context and fusion ---------------------------------------------------------------------------------------------

_DROP = ", at_text, near, lp, ln, np, nn, delta, why, dropped"


@query(_flat_sql(o.THROUGH_CONTEXT, "c", _DROP))
def context_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(scored(spark, sf_dir))


@query(f"{o.THROUGH_CONTEXT} SELECT doc_id, page_number, block_ord, detection_type, text, confidence, array_to_string(reasons, '; ') AS reasons FROM x WHERE dropped")
def context_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(context.score(found(spark, sf_dir), S(spark, sf_dir)).filter("dropped")).select("doc_id", "page_number", "block_ord", "detection_type", "text", "confidence", "reasons")


@query(_flat_sql(o.THROUGH_FUSION, "f", ", prio"))
def fused_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(fused(spark, sf_dir))


_REPEATED = f"{o.WITH}, a AS (SELECT * FROM ({o.aadhaar(dedupe=False)}) UNION ALL BY NAME SELECT * FROM ({o.phone_raw()})), f AS ({o.fused('a')})"


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S(spark, sf_dir)
    return d.scan(b, d.AADHAAR, 1, dedupe="none").unionByName(d.scan(b, d.PHONE, 3, dedupe="none"))


@query(_flat_sql(_REPEATED, "f", ", prio"))
def fused_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence kept (no document-wide de-duplication), so patterns of one detector overlap."""
    return flat(fusion.fuse(_repeated(spark, sf_dir)))


@query(
    f"""{_REPEATED} SELECT a.doc_id, a.page_number, a.detection_type, f.text AS kept_text, a.text AS merged_text, f.start AS kept_start, 'higher confidence (' || printf('%.2f', f.confidence) || '>' || printf('%.2f', a.confidence) || ')' AS reason
    FROM a JOIN f ON a.doc_id = f.doc_id AND a.page_number = f.page_number AND a.detection_type = f.detection_type AND a.block_ord = f.block_ord AND a.start < f."end" AND f.start < a."end" AND (a.pattern_ord <> f.pattern_ord OR a.start <> f.start)"""
)
def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merge_log(_repeated(spark, sf_dir)).select("doc_id", "page_number", "detection_type", "kept_text", "merged_text", "kept_start", "reason")


# --- decisions ------------------------------------------------------------------------------------------------------

_ENTRY = 'doc_id, entry_ord, page_number, block_ord, detection_type, text, start, "end", confidence, suggested_action, suggestion_reason'
_ENTRY_COLUMNS = ["doc_id", "entry_ord", "page_number", "block_ord", "detection_type", "text", "start", "end", "confidence", "suggested_action", "suggestion_reason"]


def _suggest(name: str, policy: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entries(spark, sf_dir, policy).select(*_ENTRY_COLUMNS)

    run.__name__ = name
    query(f"{o.THROUGH_FUSION} SELECT {_ENTRY} FROM ({sql})")(run)


_E = o.suggested("f", "share-with-ai")
_suggest("review_suggestions_share_with_ai", "share-with-ai", _E)
_suggest("review_suggestions_kyc", "kyc", o.suggested("f", "kyc", keep=("PAN", "AADHAAR")))
_suggest("review_suggestions_minimal", "minimal", o.suggested("f", "minimal", default="ask"))
_WITH_E = f"{o.THROUGH_FUSION}, e AS (SELECT *, {o.DETECTION_ID} AS detection_id FROM ({_E}))"


@query(f"{_WITH_E} SELECT doc_id, count(*) FILTER (suggested_action = 'redact')::BIGINT AS n_redact, count(*) FILTER (suggested_action = 'ask')::BIGINT AS n_ask, count(*) FILTER (suggested_action = 'keep')::BIGINT AS n_keep FROM e GROUP BY doc_id")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.counts(entries(spark, sf_dir))


@query(f"{_WITH_E} SELECT {_ENTRY} FROM e WHERE suggested_action = 'ask'")
def pending_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.pending(entries(spark, sf_dir)).select(*_ENTRY_COLUMNS)


@query(f"{_WITH_E} SELECT {_ENTRY} FROM e WHERE suggested_action IN ('redact', 'ask')")
def resolve_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.resolve(entries(spark, sf_dir), accept_suggestions=True).select(*_ENTRY_COLUMNS)


@query(f"{_WITH_E} SELECT doc_id, entry_ord, detection_id, suggested_action, CASE WHEN suggested_action = 'ask' THEN 'keep' END AS decision, CASE WHEN suggested_action = 'ask' THEN 'keep' ELSE suggested_action END AS action FROM e")
def bulk_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = decision.decide_all(entries(spark, sf_dir), F.col("suggested_action") == "ask", "keep")
    return e.select("doc_id", "entry_ord", "detection_id", "suggested_action", "decision", decision.effective(e).alias("action"))


def _sourced(e: DataFrame) -> DataFrame:
    return e.withColumns({"source_path": F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "source_sha256": F.sha2(F.col("doc_id").cast("string"), 256)})


@query(f"{_WITH_E} SELECT doc_id, entry_ord, detection_id, CASE WHEN suggested_action = 'ask' AND doc_id % 2 = 0 THEN 'keep' END AS decision FROM e")
def restore_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan saved as JSON and read again; sources with an odd id have changed since, so nothing of theirs comes back."""
    e = _sourced(entries(spark, sf_dir))
    saved = plans.from_json(plans.to_json(decision.decide_all(e, F.col("suggested_action") == "ask", "keep"), "share-with-ai"))
    now = e.withColumn("source_sha256", F.when(F.col("doc_id") % 2 == 0, F.col("source_sha256")).otherwise("changed"))
    same = saved.withColumns({"detector_ord": F.lit(0), "pattern_ord": F.lit(0)})
    return decision.restore(now.select(*[c for c in now.columns if c in same.columns]), same).select("doc_id", "entry_ord", "detection_id", "decision")


# --- redaction ------------------------------------------------------------------------------------------------------

_WITH_R = f"{_WITH_E}, r AS (SELECT *, repeat('*', greatest(3, least(length(text), 32))) AS replacement_text FROM e WHERE suggested_action IN ('redact', 'ask'))"


def _redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.plan(decision.resolve(entries(spark, sf_dir), accept_suggestions=True))


@query(f'{_WITH_R} SELECT doc_id, page_number, block_ord, detection_type, start, "end", \'replace\' AS redaction_type, replacement_text FROM r')
def redaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redactions(spark, sf_dir).select("doc_id", "page_number", "block_ord", "detection_type", "start", "end", "redaction_type", "replacement_text")


@query(f"{_WITH_R} SELECT doc_id, page_number, count(*)::BIGINT AS n_redactions FROM r GROUP BY ALL")
def redactions_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.by_page(_redactions(spark, sf_dir))


@query(f"{_WITH_R} SELECT detection_type, count(*)::BIGINT AS n_redactions FROM r GROUP BY ALL")
def redactions_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.by_type(_redactions(spark, sf_dir))


_SPLICED = """sp AS (SELECT doc_id, page_number, block_ord, list({'s': start, 'e': "end", 'r': replacement_text, 'pos': 0, 'out': ''} ORDER BY start, "end", replacement_text) AS xs, count(*)::BIGINT AS n FROM r GROUP BY ALL),
    j AS (SELECT s.*, coalesce(n, 0) AS n_redactions, list_prepend({'s': 0, 'e': 0, 'r': '', 'pos': 0, 'out': ''}, coalesce(xs, [])) AS xs FROM s LEFT JOIN sp USING (doc_id, page_number, block_ord)),
    k AS (SELECT *, list_reduce(xs, lambda a, x: CASE WHEN x.s >= a.pos THEN {'s': x.s, 'e': x.e, 'r': x.r, 'pos': greatest(a.pos, x.e), 'out': a.out || substr(text, a.pos + 1, x.s - a.pos) || x.r}
      WHEN x.e > a.pos THEN {'s': x.s, 'e': x.e, 'r': x.r, 'pos': x.e, 'out': a.out || repeat('*', x.e - a.pos)} ELSE a END) AS z FROM j)
    SELECT doc_id, page_number, block_ord, z.out || substr(text, z.pos + 1) AS redacted_text, n_redactions FROM k"""


@query(f"{_WITH_R}, {_SPLICED}")
def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redacted_blocks(S(spark, sf_dir), _redactions(spark, sf_dir)).select("doc_id", "page_number", "block_ord", "redacted_text", "n_redactions")


_VALUES = f"""v AS (SELECT * REPLACE (50.0 + start * 6.0 AS x0, 50.0 + "end" * 6.0 AS x1) FROM c), f AS ({o.fused("v")})"""
_REVIEWED = f"""{o.THROUGH_CONTEXT}, {_VALUES}, e AS ({_E}), r AS (SELECT *, repeat('*', greatest(3, least(length(text), 32))) AS replacement_text FROM e WHERE detection_type <> 'PHONE' AND suggested_action IN ('redact', 'ask'))"""


@query(f"{_REVIEWED}, {_SPLICED}")
def review_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole review: run, phones kept, addresses kept and that taken back, applied."""
    s = S(spark, sf_dir)
    sources = s.select("doc_id").distinct().withColumns({"source_path": F.col("doc_id").cast("string"), "source_sha256": F.sha2(F.col("doc_id").cast("string"), 256)})
    r = review.Review(s, sources, registry=registry.default_registry(names=False)).run()
    r.decide_all(F.col("detection_type") == "PHONE", decision.KEEP).decide_all(F.col("detection_type") == "EMAIL", decision.KEEP).undo()
    return r.apply().select("doc_id", "page_number", "block_ord", "redacted_text", "n_redactions")


_DRAWN = f"""{o.WITH}, q AS ({o.email()}), j AS (SELECT doc_id, page_number, block_ord, text AS value, start, "end", 50.0 + start * 6.0 AS x0, y0 FROM q),
ln AS (SELECT s.*, CASE WHEN s.block_ord % 2 = 1 THEN 'cour' ELSE 'tiro' END AS font FROM s SEMI JOIN j ON s.doc_id = j.doc_id AND s.block_ord = j.block_ord),
cuts AS (SELECT doc_id, block_ord, list("end" ORDER BY start) AS ends, list(start ORDER BY start) AS starts FROM j GROUP BY ALL),
p AS (SELECT doc_id, page_number, y0, font, text, list_prepend(0, ends) AS a, list_append(starts, length(text)) AS b FROM ln JOIN cuts USING (doc_id, block_ord)),
piece AS (SELECT doc_id, page_number, y0, font, substr(text, lo + 1, hi - lo) AS text, lo FROM (SELECT *, unnest(a) AS lo, unnest(b) AS hi FROM p)),
op AS (SELECT doc_id, page_number, 1 AS step, 'remove' AS op, NULL AS text, x0 AS x, NULL AS y, NULL AS font, NULL AS color FROM ln
UNION ALL SELECT doc_id, page_number, 2, 'clear', NULL, x0, NULL, NULL, NULL FROM j UNION ALL SELECT doc_id, page_number, 3, 'fill', NULL, x0, NULL, NULL, 16777215 FROM j
UNION ALL SELECT doc_id, page_number, 4, 'text', repeat('*', greatest(3, least(length(value), 32))), x0, y0 + 11.0, CASE WHEN block_ord % 2 = 1 THEN 'cour' ELSE 'tiro' END, 255 FROM j
UNION ALL SELECT doc_id, page_number, 5, 'text', text, 50.0 + lo * 6.0, y0 + 11.0, font, 255 FROM piece WHERE regexp_matches(text, '\\S'))
SELECT doc_id, page_number, step, op, text, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y, font, color::INT AS color FROM op"""


@query(_DRAWN)
def drawing_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a renderer draws to redact addresses, in two fonts by turns."""
    s = _with_words(S(spark, sf_dir))
    jobs = redaction.plan(d.scan(s, d.EMAIL, values_only=True)).withColumn("replacement_text", redaction.stars(F.col("text")))
    font = F.when(F.col("block_ord") % 2 == 1, "CourierNewPSMT").otherwise("Georgia-Bold")
    x = lambda i: F.col("bbox.x0") + i * 6.0
    one = lambda c, i: F.struct(c.alias("char"), g.box(x(i), F.col("bbox.y0"), x(i) + 6.0, F.col("bbox.y1")).alias("bbox"), x(i).alias("x"), (F.col("bbox.y0") + 11.0).alias("y"), font.alias("font"), F.lit(10.0).alias("size"), F.lit(255).alias("color"))
    lines = s.select("doc_id", "page_number", F.col("block_ord").alias("line_ord"), "bbox", F.transform(F.split("text", ""), one).alias("chars"))
    ops = rendering.drawing(lines, jobs.select("doc_id", "page_number", "redaction_type", "replacement_text", "bbox"))
    return ops.select("doc_id", "page_number", "step", "op", "text", F.round(F.coalesce("x", "bbox.x0"), 6).alias("x"), F.round("y", 6).alias("y"), "font", "color")


@query(
    f"""{_WITH_R}, j AS (SELECT doc_id, page_number, x0, y0, x1, y1, arg_max(replacement_text, lpad(start::VARCHAR, 9, '0') || '|' || detection_type || '|' || lpad(block_ord::VARCHAR, 9, '0') || detector_ord::VARCHAR || pattern_ord::VARCHAR) AS replacement_text FROM r GROUP BY ALL)
    SELECT doc_id, page_number, 'replace' AS redaction_type, replacement_text, x0, y0, x1, y1 FROM j"""
)
def merged_redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's detections have their block's box and its blocks meet at edges only, so boxes merge within a block."""
    out = redaction.merged_jobs(_redactions(spark, sf_dir))
    return out.select("doc_id", "page_number", "redaction_type", "replacement_text", "bbox.*")


@query(f"""{o.WITH}, q AS ({o.email()}) SELECT DISTINCT doc_id, page_number, round(50.0 + start * 6.0, 1)::DOUBLE AS x0, y0, round(50.0 + "end" * 6.0, 1)::DOUBLE AS x1, y1 FROM q""")
def refined_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of e-mail redactions whose own box is the whole block's."""
    b = _with_words(S(spark, sf_dir))
    out = redaction.refined_boxes(redaction.plan(d.scan(b, d.EMAIL, 2)), b)
    return out.select("doc_id", "page_number", F.round("bbox.x0", 1).alias("x0"), F.col("bbox.y0").alias("y0"), F.round("bbox.x1", 1).alias("x1"), F.col("bbox.y1").alias("y1"))


# --- hybrid, quality, layout, banks ---------------------------------------------------------------------------------

#: As OCR: every third block is missing from the native text, every OCR box is moved by two points.
_OCR = f"{o.WITH}, nat AS (SELECT * FROM s WHERE block_ord % 3 <> 0), ocr AS (SELECT * REPLACE (x0 + 2.0 AS x0, x1 + 2.0 AS x1, y0 + 1.0 AS y0, y1 + 1.0 AS y1) FROM s)"
_MERGED = f"""{_OCR}, m AS (SELECT doc_id, page_number, block_ord, text, 'native' AS provenance FROM nat UNION ALL SELECT doc_id, page_number, block_ord, text, 'ocr' FROM ocr a WHERE NOT EXISTS
(SELECT 1 FROM nat b WHERE a.doc_id = b.doc_id AND a.page_number = b.page_number AND greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > (b.x1 - b.x0) * (b.y1 - b.y0) * 0.5))"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S(spark, sf_dir)
    moved = g.box(F.col("bbox.x0") + 2.0, F.col("bbox.y0") + 1.0, F.col("bbox.x1") + 2.0, F.col("bbox.y1") + 1.0)
    return hybrid.merge(s.filter("block_ord % 3 <> 0"), s.withColumn("bbox", moved))


@query(f"{_MERGED} SELECT * FROM m")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("doc_id", "page_number", "block_ord", "text", "provenance")


@query(f"{_MERGED} SELECT provenance, count(*)::BIGINT AS n_blocks FROM m GROUP BY provenance")
def block_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.summary(_hybrid(spark, sf_dir))


#: Rounding as Spark does it, by the number's decimal digits: hence the casts.
_SCORES = """t AS (SELECT doc_id, text, length(text)::DOUBLE AS n, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM source WHERE regexp_matches(text, '\\S')),
p AS (SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{fffd}]', '', 'g')) / n AS a, greatest(0.0::DOUBLE, 1 - (length(text) - length(replace(text, chr(65533), ''))) / n * 5.0) AS b,
greatest(0.0::DOUBLE, 1 - len(list_filter(ws, lambda w: length(w) < 3)) / len(ws) * 2) AS c, greatest(0.0::DOUBLE, 1 - len(list_filter(ws, lambda w: length(w) > 50)) / len(ws) * 10.0::DOUBLE) AS d,
(length(text) - length(regexp_replace(text, '\\s', '', 'g'))) / n AS e FROM t),
q AS (SELECT doc_id, a, b, c, d, CASE WHEN e < 0.02::DOUBLE OR e > 0.50::DOUBLE THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS e FROM p),
r AS (SELECT source.doc_id, coalesce(round((greatest(0.0::DOUBLE, least(1.0::DOUBLE, a * 0.30::DOUBLE + b * 0.20::DOUBLE + c * 0.15::DOUBLE + d * 0.20::DOUBLE + e * 0.15::DOUBLE)))::DECIMAL(30, 18), 4)::DOUBLE, 0.0) AS overall_score,
coalesce(round(a::DECIMAL(30, 18), 4)::DOUBLE, 0.0) AS printable_ratio, coalesce(round(b::DECIMAL(30, 18), 4)::DOUBLE, 0.0) AS replace_penalty, coalesce(round(c::DECIMAL(30, 18), 4)::DOUBLE, 0.0) AS fragmentation_score, coalesce(round(d::DECIMAL(30, 18), 4)::DOUBLE, 0.0) AS token_quality, coalesce(round(e::DECIMAL(30, 18), 4)::DOUBLE, 0.0) AS whitespace_ratio
FROM source LEFT JOIN q ON source.doc_id = q.doc_id)"""


_QUALITY = f"WITH source AS (SELECT doc_id, text FROM documents), {_SCORES.strip()}"
_DIAGNOSED = f"""WITH {o.LINES}, source AS (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY block_ord) FILTER (regexp_matches(text, '\\S')), '') AS text, count(DISTINCT page_number)::BIGINT AS page_count FROM l GROUP BY doc_id), {_SCORES.strip()}"""


@query(f"{_QUALITY} SELECT * FROM r")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(docs(spark, sf_dir)).select("doc_id", "overall_score", "printable_ratio", "replace_penalty", "fragmentation_score", "token_quality", "whitespace_ratio")


@query(f"{_QUALITY} SELECT doc_id, CASE WHEN overall_score < 0.3 OR NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'ocr' WHEN overall_score < 0.7 THEN 'hybrid' ELSE 'native' END AS recommendation FROM r JOIN documents USING (doc_id)")
def pipeline_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality(docs(spark, sf_dir))
    has = F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return q.select("doc_id", quality.recommend(F.lit(False), F.lit(1), has, F.lit(False), F.col("overall_score")).alias("recommendation"))


@query(f"{_QUALITY} SELECT doc_id, doc_id % 5 AS image_count, (doc_id % 5) > 3 OR (doc_id % 5 > 0 AND overall_score < 0.2) AS estimated_scanned FROM r")
def estimate_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality(docs(spark, sf_dir)).withColumn("image_count", F.col("doc_id") % 5)
    return q.select("doc_id", "image_count", quality.looks_scanned(F.lit(1), F.col("image_count"), F.col("overall_score")).alias("estimated_scanned"))


@query("SELECT s_suppkey AS n, CASE s_suppkey % 4 WHEN 0 THEN 'Native text extraction' WHEN 1 THEN 'Full OCR processing' WHEN 2 THEN 'Hybrid (native + OCR merge)' ELSE 'Unknown (fax)' END AS label FROM supplier")
def pipeline_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("n"))
    source = F.get(F.array(*(F.lit(x) for x in ("native", "ocr", "hybrid", "fax"))), (F.col("n") % 4).cast("int"))
    return n.select("n", quality.label(source).alias("label"))


@query(
    f"""{_QUALITY}, c AS (SELECT r.doc_id, r.doc_id % 2 = 0 AS auto, r.doc_id % 3 = 0 AS force_ocr, regexp_matches(coalesce(text, ''), '\\S') AS has, CASE WHEN overall_score < 0.3 OR NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'ocr' WHEN overall_score < 0.7 THEN 'hybrid' ELSE 'native' END AS rec FROM r JOIN documents USING (doc_id))
    SELECT doc_id, CASE WHEN auto AND rec = 'native' THEN 'native' WHEN NOT auto AND NOT force_ocr THEN 'native' WHEN has THEN 'hybrid' ELSE 'ocr' END AS source FROM c"""
)
def pipeline_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text a document's run would use, for the four ways to ask (automatic or not, OCR forced or not)."""
    q = quality.quality(docs(spark, sf_dir))
    has = F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    rec = quality.recommend(F.lit(False), F.lit(1), has, F.lit(False), F.col("overall_score"))
    auto, force = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    source = F.when(auto & force, quality.route(rec, True, True, has)).when(auto, quality.route(rec, True, False, has)).when(force, quality.route(rec, False, True, has)).otherwise(quality.route(rec, False, False, has))
    return q.select("doc_id", source.alias("source"))


@query(
    f"""{_DIAGNOSED} SELECT doc_id, page_count, 0::BIGINT AS image_count, text <> '' AS has_native_text, overall_score, false AS estimated_scanned, doc_id % 11 = 0 AS is_encrypted, CASE WHEN doc_id % 7 = 0 THEN '1' ELSE '' END AS rotated_pages,
    CASE WHEN doc_id % 11 = 0 OR text = '' OR overall_score < 0.3 THEN 'ocr' WHEN overall_score < 0.7 THEN 'hybrid' ELSE 'native' END AS recommendation FROM r JOIN source USING (doc_id)"""
)
def document_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some documents are encrypted, the first page of some is turned."""
    b = L(spark, sf_dir)
    known = text.pages_of(b).withColumns({"rotation": F.when((F.col("doc_id") % 7 == 0) & (F.col("page_number") == 1), 90).otherwise(360), "encrypted": F.col("doc_id") % 11 == 0})
    return quality.diagnose(b, pages=known).withColumn("rotated_pages", F.array_join(F.col("rotated_pages").cast("array<string>"), ","))


_LAYOUT = f"""{o.WITH}, k AS (SELECT *, CASE WHEN (y0 + y1) / 2 > 842.0 * (1 - 0.1::DOUBLE) THEN CASE WHEN regexp_full_match(trim(text), '[0-9]+') AND length(trim(text)) <= 10 THEN 'page_number' ELSE 'footer' END
WHEN (y0 + y1) / 2 < 842.0 * 0.1::DOUBLE THEN 'header' ELSE 'paragraph' END AS element_type FROM s),
g0 AS (SELECT *, coalesce(y0 - lag(y1) OVER w >= 15.0, true)::INT AS new, row_number() OVER w AS place FROM k WHERE element_type = 'paragraph' WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_ord)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY place) AS para FROM g0),
para AS (SELECT doc_id, page_number, para::BIGINT AS place, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY place) AS text, count(*)::BIGINT AS n_blocks FROM g GROUP BY doc_id, page_number, para),
el AS (SELECT doc_id, page_number, element_type, x0, y0, x1, y1, text, 1::BIGINT AS n_blocks, 0 AS late, block_ord AS place FROM k WHERE element_type <> 'paragraph' UNION ALL BY NAME SELECT *, 'paragraph' AS element_type, 1 AS late FROM para),
ro AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, late, place) - 1)::INT AS reading_order FROM el)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S(spark, sf_dir)
    return layout.elements(s, statements.pages(s))


@query(f"{_LAYOUT} SELECT doc_id, page_number, element_type, text, n_blocks, reading_order, x0, y0, x1, y1 FROM ro")
def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select("doc_id", "page_number", "element_type", "text", "n_blocks", "reading_order", "bbox.*")


@query(f"{_LAYOUT} SELECT doc_id, page_number, place AS para, text, n_blocks FROM para")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S(spark, sf_dir)
    return layout.paragraphs(layout.classified(s, statements.pages(s))).select("doc_id", "page_number", F.col("para").cast("bigint").alias("para"), "text", "n_blocks")


@query(f"{_LAYOUT} SELECT doc_id, page_number, element_type, count(*)::BIGINT AS n_elements FROM ro GROUP BY ALL")
def layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.counts(_elements(spark, sf_dir))


@query(
    f"""{_LAYOUT}, n AS (SELECT doc_id, page_number, element_type, count(*) AS n FROM ro GROUP BY ALL),
    pg AS (SELECT doc_id, page_number, '{{"page_number":' || page_number || ',"elements":{{' || string_agg('"' || element_type || '":' || n, ',' ORDER BY element_type) || '}}}}' AS p FROM n GROUP BY doc_id, page_number)
    SELECT doc_id, count(*)::BIGINT AS page_count, 0::BIGINT AS image_count, '[' || string_agg(p, ',' ORDER BY page_number) || ']' AS layout FROM pg GROUP BY doc_id"""
)
def layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S(spark, sf_dir)
    return layout.report(s, statements.pages(s)).select("doc_id", "page_count", "image_count", F.to_json("layout").alias("layout"))


@query(
    f"""{_DIAGNOSED}, n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
    x AS (SELECT e.doc_id, page_count IS NULL AS none, page_count, text <> '' AS has, overall_score AS score, coalesce(n, 0) AS n, CASE WHEN text = '' OR overall_score < 0.3 THEN 'ocr' WHEN overall_score < 0.7 THEN 'hybrid' ELSE 'native' END AS way
      FROM (SELECT doc_id FROM documents) e LEFT JOIN (SELECT * FROM r JOIN source USING (doc_id)) USING (doc_id) LEFT JOIN n USING (doc_id)),
    f AS (SELECT doc_id, list_filter([CASE WHEN none THEN 'no diagnostics' END, CASE WHEN NOT none AND way <> 'native' THEN 'pipeline: expected native, got ' || way END,
      CASE WHEN page_count < 1 + doc_id % 2 THEN 'pages: expected >= ' || (1 + doc_id % 2) || ', got ' || page_count END, CASE WHEN has <> (doc_id % 5 <> 0) THEN 'text: expected ' || (doc_id % 5 <> 0) || ', got ' || has END,
      CASE WHEN score < 0.95::DOUBLE THEN 'quality: expected >= 0.95, got ' || score END, CASE WHEN n < 1 + doc_id % 4 THEN 'layout: expected >= ' || (1 + doc_id % 4) || ', got ' || n END], lambda v: v IS NOT NULL) AS v FROM x)
    SELECT doc_id, len(v) = 0 AS passed, array_to_string(v, '; ') AS failures FROM f"""
)
def expectations_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L(spark, sf_dir)
    k = F.col("doc_id")
    asked = {"pipeline": F.lit("native"), "min_pages": 1 + k % 2, "has_text": k % 5 != 0, "encrypted": F.lit(False), "min_quality": F.lit(0.95), "min_elements": 1 + k % 4}
    return flat(evaluation.expectations_met(quality.diagnose(b), b, docs(spark, sf_dir).select("doc_id").withColumns(asked)))


def _bank_sql() -> str:
    lx = names.lx
    first = lambda ps, group=0: "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', {group}), '')" for p in ps) + ")"
    day = lambda gr: f"strptime(nullif(regexp_extract(text, '{lx.PERIODS[0]}', {gr}), ''), '%d %b %Y')::DATE"
    base = f"""b AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_number, block_ord) AS text, count(DISTINCT page_number)::BIGINT AS page_count FROM s WHERE text <> '' GROUP BY doc_id),
    p AS (SELECT *, {first((lx.BANK_IFSC,))} AS code, {first(lx.HOLDERS, 1)} AS holder, {day(1)} AS st, {day(2)} AS en FROM b)"""
    parts = []
    for k, (bank, (aliases, prefixes, accounts)) in enumerate(lx.BANKS.items()):
        foreign = f"(code IS NOT NULL AND substr(code, 1, 4) NOT IN ({o.quoted(prefixes)}))"
        named = " OR ".join(f"contains(lower(text), '{a}')" for a in aliases)
        own = lambda c: f"CASE WHEN NOT {foreign} THEN {c} END"  # noqa: E731, B023
        parts.append(f"SELECT doc_id, page_count, '{bank}' AS bank_name, {k} AS bank_ord, CASE WHEN {foreign} THEN 0.0::DOUBLE ELSE (CASE WHEN code IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {named} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) END AS confidence, {own(first(accounts))} AS account_number, {own('code')} AS ifsc_code, {own('holder')} AS account_holder, {own('st')} AS statement_start, {own('en')} AS statement_end FROM p")
    one = lambda c: f"CASE WHEN {c} IS NOT NULL THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
    parts.append(f"SELECT doc_id, page_count, 'generic', {len(lx.BANKS)}, 0.1::DOUBLE + {one('code')} + {one('st')} + {one('holder')}, NULL, code, holder, st, en FROM p")
    return f"{o.WITH}, {base}, v AS ({' UNION ALL '.join(parts)})"


_BANKS = _bank_sql()


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.profiles(banks.full_text(S(spark, sf_dir)))


@query(f"{_BANKS} SELECT * FROM v")
def bank_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir)


@query(f"{_BANKS} SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, bank_ord) AS nth FROM v) WHERE nth = 1")
def bank_profile_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.best(_profiles(spark, sf_dir))


@query(f"{_BANKS} SELECT doc_id, st AS statement_start, en AS statement_end, (en - st)::BIGINT AS n_days FROM p")
def statement_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = banks.period(F.col("text"))
    p = banks.full_text(S(spark, sf_dir)).select("doc_id", start.alias("statement_start"), end.alias("statement_end"))
    return p.withColumn("n_days", F.datediff("statement_end", "statement_start").cast("bigint"))


# --- review session -------------------------------------------------------------------------------------------------

_TERMS = [("Maya  Kulkarni", "customer name", False, "a.pdf", False), ("PAYEE", "payee", True, "a.pdf", False), ("branch", "branch", False, "b.pdf", True)]


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TERMS, session.TERMS)


_START = "sum(length(text) + 1) OVER (PARTITION BY doc_id, page_number ORDER BY block_ord) - length(text) - 1"
_PAGED = f"{o.WITH}, s2 AS (SELECT *, ({_START})::INT AS page_start FROM s)"


def _instances_sql(pattern: str, label: str) -> str:
    return f"SELECT m.doc_id, m.page_number, m.block_ord, '{label}' AS detection_type, raw AS text, (page_start + start)::INT AS start, (page_start + \"end\")::INT AS \"end\" FROM ({o.spans(pattern, 0, 's2')}) m JOIN s2 USING (doc_id, page_number, block_ord)"


_MARKED = f"{_PAGED}, i AS ({_instances_sql('(?i:maya\\s+kulkarni)', 'CUSTOMER_NAME')} UNION ALL {_instances_sql('PAYEE', 'PAYEE')})"
_MARK_COLUMNS = ["doc_id", "page_number", "block_ord", "detection_type", "text", "start", "end"]


@query("SELECT * FROM (VALUES ('Maya  Kulkarni', 'customer name'), ('PAYEE', 'payee')) t(term, label)")
def active_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.active_terms(_terms(spark)).select("term", "label")


@query("SELECT * FROM (VALUES ('Maya  Kulkarni', 'customer name', false), ('PAYEE', 'payee', true), ('BRANCH', 'branch', false)) t(term, label, ignored)")
def term_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term that comes again (in another case) replaces the old and is no longer ignored; another is ignored."""
    new = spark.createDataFrame([("BRANCH", "branch", False, "c.pdf", False), ("  ", "x", False, "c.pdf", False)], session.TERMS)
    terms = session.add_terms(_terms(spark), new)
    return session.ignore_terms(terms, spark.createDataFrame([("payee", "payee")], "term string, label string")).select("term", "label", "ignored")


@query(f"{_MARKED} SELECT *, {o.DETECTION_ID} AS detection_id FROM i")
def mark_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All instances of marked terms, with page-level offsets."""
    return session.instances(S(spark, sf_dir), session.active_terms(_terms(spark))).select(*_MARK_COLUMNS, "detection_id")


@query(f"{_MARKED} SELECT doc_id, detection_type, text, start, 'redact' AS suggested_action FROM i")
def remembered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.remembered(S(spark, sf_dir), _terms(spark), decision.get_policy()).select("doc_id", "detection_type", "text", "start", "suggested_action")


_KNOWN = "(detection_type = 'PAYEE' AND doc_id % 2 = 0 OR detection_type = 'CUSTOMER_NAME' AND doc_id % 3 = 0)"


@query(f"{_MARKED} SELECT doc_id, sum((NOT {_KNOWN})::INT)::BIGINT AS added, sum({_KNOWN}::INT)::BIGINT AS skipped FROM i GROUP BY doc_id")
def mark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some payees are marked already, with the same id; some names too, by another label and so another id, in the same box."""
    instances = session.instances(S(spark, sf_dir), session.active_terms(_terms(spark)))
    name = F.col("detection_type") == "CUSTOMER_NAME"
    relabelled = {"detection_type": F.when(name, "OWNER").otherwise(F.col("detection_type")), "detection_id": F.when(name, F.concat(F.lit("owner-"), "detection_id")).otherwise(F.col("detection_id"))}
    return session.mark(instances.filter(_KNOWN).withColumns(relabelled), instances)[1]


@query(f"{_MARKED} SELECT doc_id, detection_type, text, start FROM i WHERE detection_type <> 'PAYEE'")
def forget_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = session.forget(session.remembered(S(spark, sf_dir), _terms(spark), decision.get_policy()), _terms(spark), "payee", "PAYEE")
    return left.select("doc_id", "detection_type", "text", "start")


@query(f"{_WITH_E} SELECT doc_id, detection_type, suggested_action AS action, count(*)::BIGINT AS n_entries FROM e GROUP BY ALL")
def entries_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.by_type(entries(spark, sf_dir))


@query(
    f"""{_WITH_E} SELECT doc_id, detection_id, to_json({{'detection_id': detection_id, 'detection_type': detection_type, 'text': text, 'page_number': page_number, 'confidence': confidence, 'suggested_action': suggested_action, 'action': suggested_action}})::VARCHAR AS entry FROM e"""
)
def entry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.summary(entries(spark, sf_dir))


# --- evaluation -----------------------------------------------------------------------------------------------------

#: Truth: every customer's mobile and account number, and a PAN for those with an even key.
_TRUTH = f"""t AS (SELECT k AS doc_id, unnest(['PHONE', 'ACCOUNT', 'PAN']) AS detection_type, unnest([mobile, account, CASE WHEN k % 2 = 0 THEN {statements.BLOCKS[2].replace("'PAN: ' || ", "").replace("'PAN: ABC'", "'ABC'")} END]) AS text
FROM (SELECT k, {", ".join(f"{x} AS {n}" for n, x in statements.FIELDS.items())} FROM (SELECT c_custkey AS k FROM customer)))"""
_NORMAL = "regexp_replace(regexp_replace(lower(text), '^\\+91', ''), '[\\s\\-().]', '', 'g')"
_PR = f"""{o.WITH}, {o.ALL}, {_TRUTH}, a AS (SELECT DISTINCT doc_id, detection_type, {_NORMAL} AS v FROM d WHERE detection_type IN ('PHONE', 'ACCOUNT', 'PAN')), b AS (SELECT DISTINCT doc_id, detection_type, {_NORMAL} AS v FROM t WHERE text IS NOT NULL),
j AS (SELECT coalesce(a.detection_type, b.detection_type) AS detection_type, a.v IS NOT NULL AS f, b.v IS NOT NULL AS t FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.detection_type = b.detection_type AND a.v = b.v),
pr AS (SELECT detection_type, count(*) FILTER (f AND t)::BIGINT AS tp, count(*) FILTER (f AND NOT t)::BIGINT AS fp, count(*) FILTER (t AND NOT f)::BIGINT AS fn FROM j GROUP BY detection_type),
m AS (SELECT *, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 9) AS recall FROM pr)"""


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k")).selectExpr("k", *(f"{x} AS {n}" for n, x in statements.FIELDS.items()))
    pan = F.when(F.col("k") % 2 == 0, F.expr(statements.BLOCKS[2].replace("'PAN: ABC'", "'ABC'")))
    return k.select(F.col("k").alias("doc_id"), F.explode(F.create_map(F.lit("PHONE"), "mobile", F.lit("ACCOUNT"), "account", F.lit("PAN"), pan)).alias("detection_type", "text")).filter("text is not null")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).filter(F.col("detection_type").isin("PHONE", "ACCOUNT", "PAN"))
    return evaluation.precision_recall(hits, _truth(spark, sf_dir))


@query(f"{_PR} SELECT * FROM m")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query(f"{_PR} SELECT detection_type, 1.0::DOUBLE AS base_precision, 1.0::DOUBLE AS base_recall, precision, recall FROM m WHERE precision < 0.98 OR recall < 0.98")
def metric_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.createDataFrame([(t, 1.0, 1.0) for t in ("PHONE", "ACCOUNT", "PAN")], "detection_type string, precision double, recall double")
    now = _metrics(spark, sf_dir)
    return evaluation.regressions(now, base).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


_BAG = "lower(replace(replace(replace(text, ' ', ''), '-', ''), '+91', ''))"


@query(
    f"""{o.WITH}, {o.ALL}, {_TRUTH}, a AS (SELECT doc_id, detection_type, {_BAG} AS v, count(*) AS n FROM d WHERE detection_type IN ('PHONE', 'ACCOUNT', 'PAN') GROUP BY ALL), b AS (SELECT doc_id, detection_type, {_BAG} AS v, count(*) AS n FROM t WHERE text IS NOT NULL GROUP BY ALL),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n AS f, b.n AS t FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.detection_type = b.detection_type AND a.v = b.v),
    g AS (SELECT doc_id, coalesce(sum(t) FILTER (f IS NOT NULL), 0)::BIGINT AS n_matched, coalesce(sum(t) FILTER (f IS NULL), 0)::BIGINT AS n_missed, coalesce(sum(f) FILTER (t IS NULL), 0)::BIGINT AS n_false, coalesce(sum(f), 0)::BIGINT AS n_found FROM j GROUP BY doc_id)
    SELECT doc_id, n_matched, n_missed, n_false, round(CASE WHEN n_matched + n_missed = 0 THEN 1.0 ELSE n_matched / (n_matched + n_missed) END, 9) AS recall, round(CASE WHEN n_found = 0 THEN 1.0 ELSE n_matched / n_found END, 9) AS precision FROM g"""
)
def list_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).filter(F.col("detection_type").isin("PHONE", "ACCOUNT", "PAN"))
    return evaluation.list_match(hits, _truth(spark, sf_dir)).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})
