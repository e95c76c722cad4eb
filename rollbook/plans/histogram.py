"""A run of ordered rows found by counting, without sorting or writing the table.

The rows of each range of the first order column are counted in one pre-aggregated pass. The ranges
that the run falls into are counted again in finer ranges, or by the next
column where only one value is left, until few rows remain; those are sorted. Every
pass reads one column, with the ranges found so far as filters that reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranges of one pass; their counts come to the driver.
RANGES = 1024
# So few rows are sorted.
FEW_SORTED = 10_000

_INTEGRAL = T.ByteType | T.ShortType | T.IntegerType | T.LongType
_NUMERIC = _INTEGRAL | T.FloatType | T.DoubleType | T.DecimalType


@dataclass(frozen=True)
class _Range:
    """Rows whose value lies between two values, both included, or is null (``low`` None)."""

    low: object
    high: object
    rows: int


def rows_at(
    df: DataFrame,
    order: Sequence[tuple[Column, str]],
    first: int,
    last: int,
    few: int = FEW_SORTED,
    ranges: int = RANGES,
) -> DataFrame | None:
    """The rows numbered ``first`` to ``last - 1`` by ``order``, in no order; None if a column can't be counted by ranges.

    ``order`` has a column and 'asc' (nulls last) or 'desc' (nulls first) each. Rows that are equal in
    all of them are told apart arbitrarily.
    """
    types = df.select(*[c.alias(f"_{i}") for i, (c, _) in enumerate(order)]).schema.fields
    if not all(_countable(f.dataType) for f in types):
        return None
    terms = [(_comparable(c, f.dataType), c, d, f.dataType) for (c, d), f in zip(order, types, strict=True)]
    parts = _found(df, terms, 0, None, first, last, few, ranges)
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def _countable(kind: T.DataType) -> bool:
    plain = not isinstance(kind, T.StringType) or kind == T.StringType()
    return plain and isinstance(kind, _NUMERIC | T.StringType | T.BooleanType | T.DateType | T.TimestampType)


def _comparable(column: Column, kind: T.DataType) -> Column:
    """What ranges are counted by: dates and times as numbers, so that no time zone is in the way."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    return column.cast("int") if isinstance(kind, T.BooleanType) else column


def _found(df, terms, at, known, first, last, few, ranges) -> list[DataFrame]:
    """Frames of the rows ``first`` to ``last - 1`` of ``df``, whose columns before ``at`` hold one value each.

    ``known`` is the range of column ``at`` that ``df`` is limited to, if that is known.
    """
    sort = [c.asc_nulls_last() if d == "asc" else c.desc_nulls_first() for _, c, d, _ in terms[at:]]
    if first >= last:
        return []
    if at == len(terms):
        return [df.offset(first).limit(last - first)]
    value, column, direction, kind = terms[at]
    found = _ranges(df, value, kind, known, ranges)
    found = sorted(found, key=_place(direction))
    out, begin, i = [], 0, 0
    while i < len(found) and begin < last:
        end = begin + found[i].rows
        if end <= first:
            begin, i = end, i + 1
            continue
        # Neighbours that are few together are sorted together.
        j = i + 1
        while j < len(found) and end < last and end - begin + found[j].rows <= few:
            end, j = end + found[j].rows, j + 1
        hit = found[i:j]
        rows = df.filter(_within(value, column, kind, hit))
        lo, hi = max(first - begin, 0), min(last, end) - begin
        if end - begin <= few:
            out.append(rows.orderBy(*sort).offset(lo).limit(hi - lo))
        elif hit[0].low is None or hit[0].low == hit[0].high or _is_nan(hit[0].low):
            out += _found(rows, terms, at + 1, None, lo, hi, few, ranges)
        else:
            out += _found(rows, terms, at, (hit[0].low, hit[0].high), lo, hi, few, ranges)
        begin, i = end, j
    return out


def _place(direction: str):
    """Sorts ranges as their rows: nulls last if ascending, first if descending."""

    def key(r: _Range) -> tuple:
        if r.low is None:
            return (2, 0) if direction == "asc" else (0, 0)
        return (1, _Descending(r.low)) if direction == "desc" else (1, _Ascending(r.low))

    return key


class _Ascending:
    """A value that compares as Spark compares it: text by code points, NaN above all numbers."""

    def __init__(self, value):
        self.value = (1, 0.0) if _is_nan(value) else (0, value)

    def __lt__(self, other) -> bool:
        return self.value < other.value


class _Descending(_Ascending):
    def __lt__(self, other) -> bool:
        return other.value < self.value


def _is_nan(value: object) -> bool:
    return isinstance(value, float) and math.isnan(value)


def _within(value: Column, column: Column, kind: T.DataType, hit: list[_Range]) -> Column:
    real = [r for r in hit if r.low is not None]
    null = column.isNull() if len(real) < len(hit) else F.lit(False)
    if not real:
        return column.isNull()
    ends = [r.low for r in real] + [r.high for r in real]
    low, high = min(ends, key=_Ascending), max(ends, key=_Ascending)
    back = kind if isinstance(kind, _NUMERIC | T.StringType) else None
    low, high = (F.lit(v).cast(back) if back else F.lit(v) for v in (low, high))
    if isinstance(kind, T.DateType):
        low, high, value = F.date_from_unix_date(low), F.date_from_unix_date(high), column
    return null | value.between(low, high)


def _ranges(df: DataFrame, value: Column, kind: T.DataType, known: tuple | None, ranges: int) -> list[_Range]:
    """The non-empty ranges of a column, with their smallest and largest values."""
    if known is None:
        finite = value if not isinstance(kind, T.FloatType | T.DoubleType) else F.when(F.abs(value) < math.inf, value)
        ends = df.agg(F.min(finite).alias("low"), F.max(finite).alias("high")).first()
        known = (ends["low"], ends["high"])
    bucket = F.lit(0) if known[0] is None or known[0] == known[1] else _bucket(value, kind, known, ranges)
    if isinstance(kind, T.FloatType | T.DoubleType):
        bucket = F.when(F.isnan(value), ranges + 1).when(value == math.inf, ranges).when(value == -math.inf, -1).otherwise(bucket)
    bucket = F.when(value.isNull(), F.lit(None)).otherwise(bucket)
    groups = df.groupBy(bucket.alias("_range")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    return [_Range(r["low"], r["high"], r["n"]) for r in groups.collect()]


def _bucket(value: Column, kind: T.DataType, known: tuple, ranges: int) -> Column:
    """Rises with ``value``; at least two buckets have rows."""
    low, high = known
    if isinstance(kind, T.StringType):
        shared = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        return F.substr(value, F.lit(1), F.lit(shared + 1))
    if isinstance(kind, T.FloatType | T.DoubleType):
        # Halves first, so that no difference overflows.
        above = value.cast("double") / 2 - F.lit(low / 2)
        part = F.floor(above / F.lit(high / 2 - low / 2) * ranges)
        # Values too close for a part of their difference still differ from the smallest.
        return F.when(value == F.lit(low), 0).otherwise(F.greatest(F.least(part, F.lit(ranges - 1)), F.lit(1)))
    if high - low < ranges:
        return value - F.lit(low)
    above = (value.cast("decimal(38,10)" if isinstance(kind, T.DecimalType) else "decimal(20,0)") - F.lit(low)) if not -(1 << 62) < low <= high < 1 << 62 else value - F.lit(low)
    part = F.floor(above.cast("double") / F.lit(float(high - low)) * ranges)
    return F.when(value == F.lit(low), 0).otherwise(F.greatest(F.least(part, F.lit(ranges - 1)), F.lit(1)))
