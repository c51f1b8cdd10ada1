"""Column expressions for text: line splitting, stripping, dates, model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

#: Every line end that counts, as one alternation.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def java(pattern: tuple[str, str]) -> str:
    """A fixed pattern for Spark: Unicode classes, and only \\n ends what a dot matches."""
    text, flags = pattern
    return f"(?Ud{'iu' if 'i' in flags else ''}{'s' if 's' in flags else ''})" + text.replace(r"\Z", r"\z")


def python(pattern: tuple[str, str]) -> re.Pattern[str]:
    text, flags = pattern
    return re.compile(text, (re.I if "i" in flags else 0) | (re.S if "s" in flags else 0))


def has(column: Column, pattern: tuple[str, str]) -> Column:
    return column.rlike(java(pattern))


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body uses it, also within lambdas."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly column that is evaluated once: the optimizer copies no expression through a generator."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def strip(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text, without a last empty one."""
    return let(F.split(text, LINE_END), lambda s: F.when(F.element_at(s, -1) == "", F.slice(s, 1, F.size(s) - 1)).otherwise(s))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def summary(text: Column, most: int = 240) -> Column:
    return F.substring(collapse(text), 1, most)


def is_weak(text: Column, least: int = 12) -> Column:
    """A page with almost no text of its own."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")) < least


def prose_words(line: Column) -> Column:
    return F.regexp_count(F.regexp_replace(line, java(fixed.LINKS), ""), F.lit(java(fixed.PROSE_WORD)))


def chunks(text: Column, size: int = 900, overlap: int = 150, empty_is_chunk: bool = False) -> Column:
    """Overlapping windows; the last is the first that reaches the end. An empty text gives none, or one if asked."""
    step = size - overlap
    count = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)) + 1
    made = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.substr(text, (i * step + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) > 0, made).otherwise(F.array(F.lit("")) if empty_is_chunk else F.array().cast("array<string>"))


def iso_date(value: Column) -> Column:
    """A yyyy-MM-dd date as it is, or null."""
    clean = strip(value)
    return F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(clean, "yyyy-MM-dd").isNotNull(), clean)


def body_date(text: Column) -> Column:
    """The first date after den or vom, as ISO text; null if that one is no date."""
    found = F.regexp_extract(text, java(fixed.BODY_DATE), 1)
    return F.when(found != "", F.date_format(F.try_to_date(found, "d.M.yyyy"), "yyyy-MM-dd"))


def filename_date(stem: Column) -> Column:
    parts = [F.regexp_extract(stem, r"(\d{4})[.-](\d{2})[.-](\d{2})", k) for k in (1, 2, 3)]
    return F.when(parts[0] != "", F.date_format(F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"), "yyyy-MM-dd"))


def after_label(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"(?s)^[^:]*:", ""))


def subject_id(value: Column) -> Column:
    """A subject id safe in paths; an id without any safe character is an error."""
    clean = F.regexp_replace(F.regexp_replace(strip(value), "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.when(clean.rlike(r"^\.*$"), F.raise_error(F.lit("subject id is empty or unsafe in a path"))).otherwise(clean)


def subject_scope(value: Column) -> Column:
    found = F.regexp_extract(value, r"\d+", 0)
    return F.when(found != "", found)


def fenced_json(text: Column) -> Column:
    found = F.regexp_extract(text, java(fixed.FENCE), 1)
    return F.when(has(text, fixed.FENCE), found).otherwise(text)


def visible(text: Column) -> Column:
    """A model's reply without its thinking: closed blocks, an unclosed one to the end, and stray tags."""
    out = F.coalesce(text, F.lit(""))
    for tag in fixed.THINK_TAGS:
        out = F.regexp_replace(out, f"(?Udisu)<{tag}>.*?</{tag}>", "")
    tags = "|".join(fixed.THINK_TAGS)
    out = F.regexp_replace(out, rf"(?Udisu)<(?:{tags})\b[^>]*>.*\z", "")
    return strip(F.regexp_replace(out, rf"(?Udisu)</?(?:{tags})\b[^>]*>", ""))


def url_quote(text: Column) -> Column:
    """Form encoding that keeps ~ and encodes *."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
