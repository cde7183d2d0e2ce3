"""Quality rules by host: failures of the document rules are summed by domain, each domain's failure rate is shrunk
by an empirical beta prior, and the verdict on the domain is joined back to its documents.

Document rules: fewer than ``min_words`` words, or more than half of the words in repeated 3-word windows. The prior
is fitted to the domains' rates by moments: mean m = failures / documents, variance v of the rates, strength
s = m(1 - m)/v - 1 held in [1, 1000] (10 where fewer than two domains or no variance), a = m s, b = (1 - m) s. A domain
whose shrunk rate (a + failures)/(a + b + documents) exceeds ``max_rate`` is rejected with all its documents.

Edge cases: a null text has no words and fails; a null domain is the domain of empty name; words are runs of anything but
ASCII white space, compared as they are; repeated rows count as documents of their own; an empty table gives an empty
result; extra columns stay and clashing names get a trailing underscore inside, never in the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut, prepare, texts

SYMBOLS = "#*$%&|<>"
_BLANKS = str.maketrans("\t\n\x0b\x0c\r", " " * 5)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: str) -> list[str]:
    """Runs of anything but ASCII white space."""
    if text.isascii():
        # str.split() also splits at \x1c-\x1f, which are not white space here
        return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w for w in text.translate(_BLANKS).split(" ") if w]
    return [w for w in text.translate(_BLANKS).split(" ") if w]


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = words_of(text)
    n_dup, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    n_repeat = 0
    if len(words) > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count, upto = Counter(windows), 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    n_repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_dup, n_repeat


def failed(n_words: int, n_repeat: int, min_words: int = 50, most_repeat: int = 50) -> bool:
    return n_words < min_words or 100 * n_repeat > most_repeat * n_words


def measured(docs: DataFrame, keep: list[str], prefix: str = "", min_words: int = 50) -> DataFrame:
    """The columns ``keep`` with the measures and base_failed, named with ``prefix``."""
    prepare(docs.sparkSession)
    names = [prefix + x for x in (*MEASURES, "base_failed")]
    inputs = [*keep, *(["text"] if "text" not in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(x) for x in texts(batch)]
            cols = [pa.array([g[k] for g in got], pa.int64()) for k in range(5)]
            cols.append(pa.array([failed(g[0], g[4], min_words) for g in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, *names])

    source = docs.select(*inputs)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"`{n}` bigint" for n in names[:5]), f"`{names[5]}` boolean"])
    return source.mapInArrow(run, schema)


def host_verdicts(scored: DataFrame, host: str = "source", failure: str = "base_failed", max_rate: float = 0.5) -> DataFrame:
    """host_key, n_docs, n_failed, shrunk_rate, host_ok: one row per domain."""
    by = scored.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_key")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failure).cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m, v = F.sum("n_failed") / F.sum("n_docs"), F.var_pop(rate)
    prior = by.agg(m.alias("m"), F.when((F.count(F.lit(1)) > 1) & (v > 0), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), m * (1 - m) / v - 1))).otherwise(F.lit(10.0)).alias("s"))
    shrunk = (F.col("m") * F.col("s") + F.col("n_failed")) / (F.col("s") + F.col("n_docs"))
    # The prior is one row: joining it pairs nothing with anything else.
    return by.join(F.broadcast(prior)).select("host_key", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= max_rate).alias("host_ok"))


def assess(docs: DataFrame, host: str = "source", max_rate: float = 0.5, min_words: int = 50) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, host_rate, kept."""
    scored = cut(measured(docs, ["doc_id", host], min_words=min_words), "measures")
    verdicts = host_verdicts(scored, host, max_rate=max_rate)
    joined = scored.join(verdicts, F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("host_key"))
    return joined.select("doc_id", *MEASURES, "base_failed", F.col("shrunk_rate").alias("host_rate"), (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", max_rate: float = 0.5, min_words: int = 50) -> DataFrame:
    """The documents that pass the rules and whose domain is not rejected, with their columns as they were. Texts are measured
    once; what fails by itself is written without its text, for its domain's count alone."""
    tag = "rule_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag = "_" + tag
    bad = F.col(tag + "base_failed")
    rows = measured(docs, docs.columns, tag, min_words)
    rows = cut(rows.select(*(F.when(~bad, F.col(c)).alias(c) if c == "text" else F.col(c) for c in docs.columns), bad), "measured")
    verdicts = cut(host_verdicts(rows.select(host, bad), host, tag + "base_failed", max_rate), "hosts")
    verdicts = verdicts.select(F.col("host_key").alias(tag + "host"), F.col("host_ok").alias(tag + "ok")).filter(tag + "ok")
    return rows.filter(~bad).join(verdicts, F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col(tag + "host")).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, t, host, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
lines AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM lines GROUP BY doc_id),
tok AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, p, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f GROUP BY host),
p0 AS (SELECT sum(x) / sum(n) AS m, var_pop(x / n) AS v, count(*) AS k FROM h),
p AS (SELECT m, CASE WHEN k > 1 AND v > 0 THEN greatest(1.0::DOUBLE, least(1000.0::DOUBLE, m * (1 - m) / v - 1)) ELSE 10.0::DOUBLE END AS s FROM p0),
r AS (SELECT host, round((m * s + x) / (s + n), 9) AS host_rate, (m * s + x) / (s + n) <= 0.5::DOUBLE AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, NOT base_failed AND ok AS kept
FROM f JOIN r ON f.host = r.host
"""
