"""Search predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import JS_WHITESPACE

MODES = ("contains", "exact")


def ilike_pattern(q: str, mode: str = "contains", literal: bool = False) -> str:
    """The pattern for a search text.

    ``%``, ``_`` and ``\\`` stay live unless ``literal``. A backslash before any
    other character stands for that character, so it is dropped; one at the end
    of a contains text makes the closing percent sign literal.
    """
    if mode not in MODES:
        raise ValueError(f"unknown search mode {mode!r}; use one of {MODES}")
    if literal:
        for special in ("\\", "%", "_"):
            q = q.replace(special, "\\" + special)
    wrapped = f"%{q}%" if mode == "contains" else q
    out, escaped = [], False
    for char in wrapped:
        if escaped:
            out.append("\\" + char if char in "%_\\" else char)
            escaped = False
        elif char == "\\":
            escaped = True
        else:
            out.append(char)
    if escaped:
        raise ValueError("an exact search text must not end with a backslash")
    return "".join(out)


def matches(
    terms: Sequence[tuple[str, str]], q: str, trim: bool = False, literal: bool = False
) -> Column:
    """True where any ``(column, mode)`` term matches ``q`` without regard to case."""
    text = q.strip(JS_WHITESPACE) if trim else q
    hits = [F.col(c).ilike(ilike_pattern(text, mode, literal)) for c, mode in terms]
    return reduce(lambda a, b: a | b, hits)


def search(
    df: DataFrame,
    terms: Sequence[tuple[str, str]],
    q: str,
    trim: bool = False,
    literal: bool = False,
) -> DataFrame:
    """Rows of ``df`` that match ``q`` in any of ``terms``."""
    return df.filter(matches(terms, q, trim, literal))


def eq_ci(left: Column, right: Column) -> Column:
    """Case-insensitive equality; remains a hashable join key."""
    return F.lower(left) == F.lower(right)
