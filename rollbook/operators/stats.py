"""Counts per value of chosen columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values of a dimension that have rows of their own; while there are at most 1,000, Spark thins them out before the shuffle.
TOP_VALUES = 100


def feed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The chosen columns of every row, and the total as a one-row frame."""
    return df.select(*columns), df.agg(F.count(F.lit(1)).alias("total"))


def distribution(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """dimension, value, n and share of all rows, null being a value of its own.

    One pass over ``df``; counts are combined before the shuffle, so a frequent
    value costs no more than a rare one.
    """
    values = [F.col(d).cast("string").alias(d) for d in dims]
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return (
        df.select(*values)
        .unpivot([], list(dims), "dimension", "value")
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n") / total)
    )


def frequent_values(df: DataFrame, dims: Sequence[str], top: int = TOP_VALUES) -> DataFrame:
    """dimension, value and n of the ``top`` most frequent values of each dimension, nulls aside; ties by value."""
    values = [F.col(d).cast("string").alias(d) for d in dims]
    counts = df.select(*values).unpivot([], list(dims), "dimension", "value").filter(F.col("value").isNotNull())
    counts = counts.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counts.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= top).drop("_nth")


def cross_distribution(
    df: DataFrame,
    dims: Sequence[str],
    size: int | Sequence[int] = 2,
    top: int = TOP_VALUES,
) -> DataFrame:
    """n and share of all rows for every combination of values, over all sets of ``size`` dimensions.

    Each row names its ``dimensions``. A dimension has its value as text and, in ``<dimension>_is``, what
    stands there: 'value', 'null', 'other' (all values but the ``top`` most frequent, counted together) or 'all' if the set
    is without it. So a set has at most ``top + 2`` values of each dimension and its shares add up to 1. Rows
    are counted once by all dimensions, with map-side combine; the sets are sums of those cells.
    """
    sizes = [size] if isinstance(size, int) else list(size)
    sets = [s for n in sizes for s in combinations(dims, n)]
    if not sets or max(sizes) > len(dims):
        raise ValueError(f"no sets of {size} among {len(dims)} dimensions")
    frequent = frequent_values(df, dims, top)
    rows = df.select(*[F.col(d).cast("string").alias(f"_v{i}") for i, d in enumerate(dims)])
    for i, d in enumerate(dims):
        known = frequent.filter(F.col("dimension") == d).select(F.col("value").alias(f"_v{i}"), F.lit(True).alias("_top"))
        rows = rows.join(F.broadcast(known), f"_v{i}", "left")  # at most ``top`` rows
        kind = F.when(F.col(f"_v{i}").isNull(), "null").when(F.col("_top"), "value").otherwise("other")
        rows = rows.withColumn(f"_k{i}", kind).withColumn(f"_v{i}", F.when(F.col("_top"), F.col(f"_v{i}"))).drop("_top")
    columns = [c for i in range(len(dims)) for c in (f"_v{i}", f"_k{i}")]
    cells = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    of_set = [[F.col(c) for d in s for c in (f"_v{dims.index(d)}", f"_k{dims.index(d)}")] for s in sets]
    summed = cells.groupingSets(of_set, *columns).agg(F.sum("_n").alias("n"), F.grouping_id().alias("_id"))
    total = df.agg(F.count(F.lit(1))).scalar()

    def absent(i: int) -> Column:
        return F.bit_get(F.col("_id"), F.lit(2 * (len(dims) - i) - 1)) == 1

    names = F.concat_ws(",", *[F.when(~absent(i), F.lit(d)) for i, d in enumerate(dims)])
    parts = [c for i, d in enumerate(dims) for c in (F.col(f"_v{i}").alias(d), F.when(absent(i), "all").otherwise(F.col(f"_k{i}")).alias(f"{d}_is"))]
    return summed.select(names.alias("dimensions"), *parts, "n", (F.col("n") / total).alias("share"))
