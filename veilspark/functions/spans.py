"""All matches of a pattern with their offsets, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "\x01"


def spans_of(text: Column, pattern: str | Column) -> Column:
    """array<struct<value, start, end>>: leftmost matches that do not overlap, offsets in characters.

    The text is marked once on both sides of every match and split at the marks; every second part is a match and the
    running length gives its place. Groups inside ``pattern`` must not capture. U+0001 in a text reads as U+0002.
    """
    clean = F.translate(text, SENTINEL, "\x02")
    wrapped = F.concat(F.lit("("), pattern, F.lit(")")) if isinstance(pattern, Column) else F.lit(f"({pattern})")
    parts = F.split(F.regexp_replace(clean, wrapped, F.lit(f"{SENTINEL}$1{SENTINEL}")), SENTINEL, -1)
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("pos"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["pos"] + F.length(part)
        here = F.struct(part.alias("value"), acc["pos"].alias("start"), end.alias("end"))
        return F.struct((acc["i"] + 1).alias("i"), end.alias("pos"), F.when(acc["i"] % 2 == 1, F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def cut_out(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start + 1, end - start)


def before(text: Column, start: Column) -> Column:
    return F.substring(text, F.lit(1), start)


def after(text: Column, end: Column) -> Column:
    return F.substring(text, end + 1, F.length(text))


def line_around(text: Column, start: Column, end: Column) -> Column:
    """The line that holds [start, end)."""
    head, tail = before(text, start), after(text, end)
    return F.concat(F.substring_index(head, "\n", -1), cut_out(text, start, end), F.substring_index(tail, "\n", 1))


def in_slashes(text: Column, start: Column, end: Column) -> Column:
    """Whether a slash touches the span: part of a reference such as A/B/123/C."""
    return (F.substring(text, start, F.lit(1)) == "/") & (start > 0) | (F.substring(text, end + 1, F.lit(1)) == "/")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def found(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(f"{flags}{pattern}")


def any_word(terms: tuple[str, ...]) -> str:
    """A pattern of the terms (in lower case) that no letter or digit touches."""
    escaped = ("".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in t) for t in terms)
    return rf"(?<![a-z0-9])({'|'.join(escaped)})(?![a-z0-9])"


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first of the terms, in their order, that occurs in the text as a whole word, whatever its case; null if none.
    One pass finds all of them; terms of a list do not overlap in a text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(any_word(terms)), F.lit(1))
    return F.get(F.array_intersect(F.array(*(F.lit(t) for t in terms)), found), F.lit(0))
