"""Text rules for cells, headers and request fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a JavaScript trim removes.
JS_WHITESPACE = (
    "\t\n\x0b\x0c\r "
    "\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
JS_WHITESPACE_CLASS = "[" + JS_WHITESPACE + "]"

HEADER_RULES = ("raw", "trim_lower", "underscore", "unquote")


def js_trim(c: Column) -> Column:
    """Strip every kind of whitespace and the byte-order mark at both ends."""
    return F.regexp_replace(c, rf"\A{JS_WHITESPACE_CLASS}+|{JS_WHITESPACE_CLASS}+\z", "")


def trim_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip spaces (only spaces) from the given columns."""
    return df.withColumns({c: F.trim(F.col(c)) for c in columns})


def blank_nulls(df: DataFrame) -> DataFrame:
    """Every column as text with nulls shown as ''."""
    return df.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    )


def or_default(c: Column, default: str) -> Column:
    """``default`` where the value is null or ''."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def is_given(c: Column) -> Column:
    """True unless the value is null or ''; spaces count as given."""
    return c.isNotNull() & (c.cast("string") != "")


def header_name(name: str | None, rule: str) -> str:
    """One header cell under one of ``HEADER_RULES``."""
    text = "" if name is None else str(name)
    if rule == "raw":
        return text
    if rule == "trim_lower":
        return text.strip(JS_WHITESPACE).lower()
    if rule == "underscore":
        return _underscored(text.lower())
    if rule == "unquote":
        return text.replace('"', "").strip(JS_WHITESPACE).lower()
    raise ValueError(f"unknown header rule {rule!r}; use one of {HEADER_RULES}")


def header_column(c: Column, rule: str) -> Column:
    """``header_name`` over a column of header cells."""
    text = F.coalesce(c, F.lit(""))
    if rule == "raw":
        return text
    if rule == "trim_lower":
        return F.lower(js_trim(text))
    if rule == "underscore":
        return F.regexp_replace(F.lower(text), rf"{JS_WHITESPACE_CLASS}+", "_")
    if rule == "unquote":
        return F.lower(js_trim(F.replace(text, F.lit('"'), F.lit(""))))
    raise ValueError(f"unknown header rule {rule!r}; use one of {HEADER_RULES}")


def normalize_header(df: DataFrame, rule: str) -> DataFrame:
    """Rename all columns of ``df`` by a header rule."""
    return df.toDF(*[header_name(c, rule) for c in df.columns])


def _underscored(text: str) -> str:
    words, gap = [], False
    for char in text:
        if char in JS_WHITESPACE:
            gap = True
            continue
        if gap:
            words.append("_")
            gap = False
        words.append(char)
    return "".join(words) + ("_" if gap else "")
