"""Typed parsing of text cells.

Strict forms raise on the first bad value whatever the session's ANSI setting;
lenient forms give null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.text import JS_WHITESPACE_CLASS

# Day zero of spreadsheet serial dates and the accepted shapes.
SERIAL_EPOCH = "1899-12-30"
DIGITS = r"\A[0-9]+\z"
ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"

_LEADING_DIGITS = rf"\A{JS_WHITESPACE_CLASS}*([+-]?[0-9]+)"


def strict_int(c: Column, strict: bool = True) -> Column:
    """Integer of trimmed text; blank is null."""
    text = F.nullif(F.trim(c), F.lit(""))
    return _checked(text, text.try_cast("int"), "integer") if strict else text.try_cast("int")


def exact_int(c: Column) -> Column:
    """Integer of text that must be one; '' is an error, null stays null."""
    return _checked(c, c.try_cast("int"), "integer")


def mixed_date(c: Column, min_serial: int = 0, strict: bool = True) -> Column:
    """Date of trimmed text that is a spreadsheet serial or YYYY-MM-DD, else null.

    Digits below ``min_serial`` are not taken as serials (a bare year would
    otherwise become a date in 1905).
    """
    text = F.trim(c)
    days = text.try_cast("int")
    date = text.try_cast("date")
    if strict:
        days = _checked(text, days, "serial date")
        date = _checked(text, date, "date")
    is_serial = text.rlike(DIGITS)
    if min_serial > 0:
        is_serial = is_serial & (text.try_cast("decimal(38,0)") >= F.lit(min_serial))
    return F.when(is_serial, F.date_add(F.lit(SERIAL_EPOCH).cast("date"), days)).when(
        text.rlike(ISO_DATE), date
    )


def leading_int(c: Column) -> Column:
    """The integer a text starts with (``12abc`` -> 12), else null."""
    return _leading_digits(c).try_cast("bigint")


def leading_int_of(value: object) -> int | None:
    """``leading_int`` of one request value."""
    match = re.match(_LEADING_DIGITS, "" if value is None else str(value))
    return int(match.group(1)) if match else None


def leading_number(c: Column) -> Column:
    """``leading_int`` as a double, for comparisons of any size."""
    return _leading_digits(c).try_cast("double")


def _leading_digits(c: Column) -> Column:
    return F.regexp_extract(c.cast("string"), _LEADING_DIGITS, 1)


def _checked(text: Column, value: Column, kind: str) -> Column:
    failure = F.raise_error(F.concat(F.lit(f"not a valid {kind}: "), text))
    return F.when(text.isNotNull() & value.isNull(), failure).otherwise(value)
