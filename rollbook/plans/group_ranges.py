"""The same run of ordered rows in every group, found by counting ranges instead of ranking the table.

The rows of each range of the first order column are counted for each group, pre-aggregated and without
other columns. Only the ranges that a group's run falls into are counted again, in finer ranges, or by the
next column where one value is left, until each holds few rows. Only the rows of those ranges travel to be ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.plans.sizing import hint_by_size
from rollbook.plans.staging import stage

# Ranges of a group in one pass, at most.
RANGES = 1024
# A range of so few rows is ranked, unless the run itself is longer.
FEW_RANKED = 1_000

_INTEGRAL = T.ByteType | T.ShortType | T.IntegerType | T.LongType
_START, _N = "_start", "_n"


def run_of_each_group(
    df: DataFrame,
    group: str,
    order: Sequence[tuple[Column, str]],
    first: int,
    last: int,
    out: str = "rank",
    few: int | None = None,
    ranges: int = RANGES,
) -> DataFrame | None:
    """Rows ``first`` to ``last - 1`` of each group, with their number from 1; None if a column can't be counted by ranges.

    ``order`` has a column and 'asc' (nulls last) or 'desc' (nulls first) each. Rows that are equal in all of
    them are told apart arbitrarily. Rows without a group are left out.
    """
    few = max(few or FEW_RANKED, last - first)
    kinds = [f.dataType for f in df.select(*[c.alias(f"_{i}") for i, (c, _) in enumerate(order)]).schema.fields]
    if first >= last or not all(_countable(k) for k in kinds):
        return None
    levels = [_Level(i, c, d, k) for i, ((c, d), k) in enumerate(zip(order, kinds, strict=True))]
    rows = df.filter(F.col(group).isNotNull()).withColumns({level.name: level.value for level in levels})

    state = _spans(rows.withColumn(_START, F.lit(0).cast("long")), [group, _START], levels[0])
    state = stage(state.filter(F.col(_N) > first), "spans")
    found: list[tuple[_Level, DataFrame]] = []
    for at, level in enumerate(levels):
        same = []
        fixed = [group, _START, *(f"{earlier.name}_is" for earlier in levels[:at])]
        one = F.col("_low").isNull() | ((F.col("_low") == F.col("_high")) & ~F.col("_nulls"))
        small = F.col(_N) <= few
        while True:
            n = state.agg(F.count_if(small).alias("small"), F.count_if(~small & one).alias("same"), F.count_if(~small & ~one).alias("more")).first()
            if n["small"]:
                found.append((level, state.filter(small)))
            if n["same"]:
                same.append(state.filter(~small & one))
            if not n["more"]:
                break
            counted = _counted(rows, state.filter(~small & ~one), group, levels[: at + 1], fixed, few, ranges)
            state = _hit(counted, group, level, first, last)
        if not same:
            break
        tied = reduce(DataFrame.unionByName, same)
        if at + 1 == len(levels):
            # Any of the rows that are equal in all columns will do.
            begin = F.greatest(F.col(_START), F.lit(first))
            found.append((level, tied.withColumns({_START: begin, _N: F.col(_N) - (begin - F.col(_START))})))
            break
        tied = tied.withColumnRenamed("_low", f"{level.name}_is").drop("_high", "_nulls", _N)
        inside = _inside(rows, tied, group, levels[: at + 1], None)
        state = stage(_spans(inside, [*fixed, f"{level.name}_is"], levels[at + 1]), "spans")

    if not found:
        return df.withColumn(out, F.lit(0).cast("long")).limit(0)
    window = Window.partitionBy(group, _START).orderBy(*(level.sort for level in levels))
    parts = []
    for level in levels:
        own = [r for at, r in found if at is level]
        if own:
            hit = reduce(DataFrame.unionByName, own)
            inside = _inside(rows, hit, group, levels[: level.at], level)
            # A task keeps no more rows of a range than this before the shuffle.
            number = F.row_number().over(window)
            parts.append(inside.withColumn("_number", number).filter((F.col("_number") <= few) & (F.col("_number") <= F.col(_N))))
    every = reduce(DataFrame.unionByName, [p.select(*df.columns, _START, "_number") for p in parts])
    rank = (F.col(_START) + F.col("_number")).cast("long")
    return every.withColumn(out, rank).filter((F.col(out) > first) & (F.col(out) <= last)).drop(_START, "_number")


class _Level:
    """One order column, as a number or text whose ranges can be counted."""

    def __init__(self, at: int, column: Column, direction: str, kind: T.DataType):
        self.at, self.name = at, f"_order{at}"
        self.text = isinstance(kind, T.StringType)
        if isinstance(kind, T.TimestampType):
            column = F.unix_micros(column)
        elif isinstance(kind, T.DateType):
            column = F.unix_date(column).cast("long")
        elif isinstance(kind, T.BooleanType):
            column = column.cast("int").cast("long")
        elif isinstance(kind, _INTEGRAL):
            column = column.cast("long")
        self.value = column
        self.sort = self.sorted(F.col(self.name), direction)
        self.direction = direction

    @staticmethod
    def sorted(column: Column, direction: str) -> Column:
        return column.asc_nulls_last() if direction == "asc" else column.desc_nulls_first()

    def bucket(self, ranges: Column) -> Column:
        """Rises with the value from ``_low`` to ``_high``; at least two buckets have rows unless these are equal."""
        value, low, high = F.col(self.name), F.col("_low"), F.col("_high")
        if self.text:
            return F.substr(value, F.lit(1), F.col("_shared") + 2)
        exact = "decimal(20,0)"
        above = (value.cast(exact) - low.cast(exact)).cast("double")
        part = F.floor(above / (high.cast(exact) - low.cast(exact)).cast("double") * ranges).cast("long")
        return F.when(value == low, F.lit(0)).otherwise(F.greatest(F.least(part, ranges - 1), F.lit(1))).cast("long")


def _countable(kind: T.DataType) -> bool:
    plain = not isinstance(kind, T.StringType) or kind == T.StringType()
    return plain and isinstance(kind, _INTEGRAL | T.StringType | T.BooleanType | T.DateType | T.TimestampType)


def _spans(rows: DataFrame, keys: Sequence[str], level: _Level) -> DataFrame:
    """Number of rows, smallest and largest value of a column, and whether it has nulls, for each of ``keys``."""
    value = F.col(level.name)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(_N), F.min(value).alias("_low"), F.max(value).alias("_high"), (F.count(value) < F.count(F.lit(1))).alias("_nulls")
    )


def _inside(rows: DataFrame, state: DataFrame, group: str, fixed: Sequence[_Level], level: _Level | None) -> DataFrame:
    """The rows of the ranges of ``state``, with its columns."""
    state = state.withColumnRenamed(group, "_group")
    meets = F.col(group) == F.col("_group")
    for earlier in fixed:
        meets &= F.col(earlier.name).eqNullSafe(F.col(f"{earlier.name}_is"))
    if level is not None:
        value = F.col(level.name)
        none = value.isNull() & (F.col("_nulls") | F.col("_low").isNull())
        meets &= none | F.coalesce(value.between(F.col("_low"), F.col("_high")), F.lit(False))
    return rows.join(hint_by_size(state)(state), meets).drop("_group")


def _counted(rows, state, group, levels, fixed, few, ranges) -> DataFrame:
    """The rows of each range of ``state``, counted by finer ranges."""
    level = levels[-1]
    # A group with fewer rows needs fewer ranges.
    parts = F.least(F.lit(ranges), F.ceil(F.col(_N) / F.lit(few)) * 4).cast("long").alias("_parts")
    columns = [*fixed, "_low", "_high", "_nulls", parts]
    if level.text:
        columns.append(_shared(F.col("_low"), F.col("_high")).alias("_shared"))
    inside = _inside(rows, state.select(*columns), group, levels[:-1], level)
    bucket = F.when(F.col("_low") == F.col("_high"), F.lit("" if level.text else 0)).otherwise(level.bucket(F.col("_parts")))
    inside = inside.withColumn("_bucket", F.when(F.col(level.name).isNotNull(), bucket))
    return _spans(inside, [*fixed, "_bucket"], level).drop("_bucket")


def _hit(counts: DataFrame, group: str, level: _Level, first: int, last: int) -> DataFrame:
    """The finer ranges that the run falls into, with the number of rows before each."""
    # A window over the ranges of one range.
    earlier = Window.partitionBy(group, _START).orderBy(level.sorted(F.col("_low"), level.direction))
    before = F.coalesce(F.sum(_N).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = counts.withColumn("_begin", F.col(_START) + before).drop(_START).withColumnRenamed("_begin", _START)
    return stage(begun.filter((F.col(_START) < last) & (F.col(_START) + F.col(_N) > first)), "spans")


def _shared(low: Column, high: Column) -> Column:
    """Characters that two texts begin with alike."""
    shorter = F.least(F.length(low), F.length(high))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.substr(low, i, F.lit(1)) != F.substr(high, i, F.lit(1)))
    return F.coalesce(F.array_min(differ) - 1, shorter)
