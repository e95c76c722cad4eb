"""Size checks that must pass before a side may be broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast relation is held by the driver and by every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
# A hashed relation is held by one task, at some six times the bytes measured, and can't spill.
HASHED_BYTES = 128 * 1024 * 1024
# Rows that measure so much are one task's share where the number of tasks follows the input.
SHARE_BYTES = 32 * 1024 * 1024
_FIXED_WIDTH = 16


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows, summed by one pre-aggregated pass over ``df``."""
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + _value_bytes(field)
    total = df.agg(F.sum(width.cast("long")).alias("bytes")).first()["bytes"]
    return int(total or 0)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` measures at most ``limit`` bytes."""
    return measured_bytes(df) <= limit


def hint_by_size(
    df: DataFrame, limit: int = BROADCAST_BYTES, hashed: bool = False
) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint if ``df`` is small, else no hint.

    For frames derived from ``df`` that have at most its rows and its columns,
    such as its distinct keys: without the hint a join of a large table with
    them would shuffle the table. ``hashed`` is for frames with unique keys: what is too large
    for a broadcast is hashed by the tasks of the shuffle while a task's share fits, so
    the table passes by and isn't sorted; beyond, both sides are sorted, which can spill.
    """
    size = measured_bytes(df)
    if size <= limit:
        return F.broadcast
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _hashed if hashed and size <= HASHED_BYTES * tasks else _as_is


def parts_by_size(*frames: DataFrame) -> int:
    """Partitions that leave each task a share of all ``frames``, no fewer than the session's."""
    tasks = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks, -(-sum(map(measured_bytes, frames)) // SHARE_BYTES))


def _hashed(df: DataFrame) -> DataFrame:
    return df.hint("shuffle_hash")


def _as_is(df: DataFrame) -> DataFrame:
    return df


def _value_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(_FIXED_WIDTH)
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        text = F.to_json(F.struct(column))
        return F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(_FIXED_WIDTH)
    return F.lit(_FIXED_WIDTH)
