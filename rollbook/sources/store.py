"""Stored tables: whole versions, and tables by key range that take merges.

A version is a folder of Parquet files that Spark's own commit completes (its
``_SUCCESS`` file); a failed write leaves the versions before it as they are.

A table by key range is partitioned by ``_from``, the smallest value of its first key column a
partition may hold (null: any). A merge reads the partitions its batch falls into,
which Spark prunes by that column, and writes them back with dynamic partition
overwrite: others are not touched, and a failed job changes none. A range that has grown
beyond ``rows_per_range`` is cut in the same write. One writer at a time; a batch that is merged again changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.operators.change import upsert
from rollbook.plans import stage
from rollbook.plans.ordering import Term

FROM = "_from"
_VERSION = "version="
_DONE = "_SUCCESS"

# Rows of a key range, which one task writes.
ROWS_PER_RANGE = 4_000_000


def publish(df: DataFrame, table_dir: str, number: int | None = None) -> str:
    """Write ``df`` as the next (or the given) version; gives its path. A given number that is complete is left as it is."""
    done = versions(df.sparkSession, table_dir)
    number = max([-1, *done]) + 1 if number is None else number
    path = _version(table_dir, number)
    if number not in done:
        # Committed by one rename for each file after all tasks have succeeded.
        writer = df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "1")
        writer.parquet(path)
    return path


def read_version(spark: SparkSession, table_dir: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version, or the newest with a number below ``before``."""
    done = [n for n in versions(spark, table_dir) if before is None or n < before]
    return spark.read.parquet(_version(table_dir, done[-1])) if done else None


def versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/{_VERSION}*/{_DONE}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().removeprefix(_VERSION)) for f in found or [])


def _version(table_dir: str, number: int) -> str:
    return f"{table_dir}/{_VERSION}{number:012d}"


def merge(
    batch: DataFrame,
    table_dir: str,
    keys: Sequence[str],
    update_cols: Sequence[str],
    order_by: Sequence[Term],
    rows_per_range: int = ROWS_PER_RANGE,
) -> None:
    """Upsert ``batch``, which has the table's columns and those of ``order_by``, into the table at ``table_dir``.

    The first key column is text, a whole number or a date. What is written is computed and staged
    before the table is changed.
    """
    spark = batch.sparkSession
    extra = {t if isinstance(t, str) else t[0] for t in order_by}
    columns = [c for c in batch.columns if c not in extra]
    schema = batch.select(*columns).schema
    kind = schema[keys[0]].dataType
    if not isinstance(kind, T.StringType | T.IntegerType | T.LongType | T.ShortType | T.DateType):
        raise ValueError(f"no key ranges of {kind.simpleString()}")
    full = T.StructType([*schema.fields, T.StructField(FROM, kind)])
    old = spark.read.schema(full).parquet(table_dir) if _exists(spark, table_dir) else spark.createDataFrame([], full)
    bounds = [r[FROM] for r in old.select(FROM).distinct().collect()]  # one for each range
    # Parsed once and whole before anything is merged.
    dealt = stage(batch.withColumn(FROM, range_of(F.col(keys[0]), bounds, kind)), "batch")
    touched = [r[FROM] for r in dealt.select(FROM).distinct().collect()]
    if not touched:
        return
    target = old.filter(_in_ranges(touched))
    merged = upsert(target.drop(FROM), dealt, keys, update_cols, order_by).after
    merged = stage(merged.withColumn(FROM, range_of(F.col(keys[0]), bounds, kind)), "merged")
    bounds += _cuts(merged, keys[0], rows_per_range)
    whole = merged.withColumn(FROM, range_of(F.col(keys[0]), bounds, kind)).repartition(FROM)
    writer = whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "1").partitionBy(FROM).parquet(table_dir)


def read_ranges(spark: SparkSession, table_dir: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table by key range at ``table_dir``; None if nothing was merged yet. Without a ``schema`` its files tell it."""
    if not _exists(spark, table_dir):
        return None
    if schema is None:
        schema = spark.read.option("recursiveFileLookup", True).parquet(table_dir).schema
    full = T.StructType([*schema.fields, T.StructField(FROM, T.StringType())])
    return spark.read.schema(full).parquet(table_dir).drop(FROM)


def range_of(key: Column, bounds: Sequence[object], kind: T.DataType) -> Column:
    """The largest bound that is not above ``key``; null below all of them.

    Bounds are looked through in two steps, of their square root each.
    """
    ends = sorted(b for b in bounds if b is not None)
    if not ends:
        return F.lit(None).cast(kind)
    step = math.isqrt(len(ends) - 1) + 1
    runs = [ends[i : i + step] for i in range(0, len(ends), step)]

    def texts(values: Sequence[object]) -> Column:
        return F.array(*(F.lit(v).cast(kind) for v in values))

    def below(array: Column) -> Column:
        return F.filter(array, lambda b: b <= key)

    run = F.size(below(texts([r[0] for r in runs])))
    chosen = F.element_at(F.array(*(texts(r) for r in runs)), F.greatest(run, F.lit(1)))
    return F.array_max(below(chosen))


def _in_ranges(touched: Sequence[object]) -> Column:
    real = [b for b in touched if b is not None]
    hit = F.col(FROM).isin(real) if real else F.lit(False)
    return hit | F.col(FROM).isNull() if len(real) < len(touched) else hit


def _cuts(merged: DataFrame, key: str, rows_per_range: int) -> list[object]:
    """Bounds inside the ranges of ``merged`` that have too many rows: where equal shares of their rows begin."""
    sizes = merged.groupBy(FROM).count().filter(F.col("count") > rows_per_range).collect()  # of ranges to cut
    if not sizes:
        return []
    large = merged.filter(_in_ranges([r[FROM] for r in sizes]))
    shares = sum(-(-r["count"] // rows_per_range) for r in sizes)
    sorted_ = large.select(key, FROM).repartitionByRange(shares, key)
    begins = sorted_.groupBy(F.spark_partition_id(), FROM).agg(F.min(key).alias("begin")).collect()
    lowest = {r[FROM]: min(s["begin"] for s in begins if s[FROM] == r[FROM]) for r in sizes}
    # A range keeps its own bound, so the first share of each needs none.
    return sorted({r["begin"] for r in begins} - set(lowest.values()))


def _exists(spark: SparkSession, table_dir: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
