"""Fixed-size parts of a table, each a file with its own header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.plans import number_rows, order_columns
from rollbook.plans.ordering import Term

ROWS_PER_PART = 1_000


def split_parts(
    df: DataFrame,
    order_by: Sequence[Term] | None = None,
    rows_per_part: int = ROWS_PER_PART,
    scanned: bool = False,
    unique: bool = False,
) -> DataFrame:
    """Every row with ``part`` and ``row_in_part``, both from 1.

    Rows count in the order of ``order_by``, or in source order if it is None.
    ``scanned`` says that ``df`` is read from files without a shuffle and
    ``unique`` that the order has no ties; either saves a sort.
    """
    columns = None if order_by is None else order_columns(order_by)
    ordinal = F.col("_ordinal")
    return (
        number_rows(df, columns, "_ordinal", unique=unique, scanned=scanned)
        .withColumns(
            {
                "part": F.floor(ordinal / F.lit(rows_per_part)) + F.lit(1),
                "row_in_part": ordinal % F.lit(rows_per_part) + F.lit(1),
            }
        )
        .drop("_ordinal")
    )


def part_name(base: str, suffix: str = ".csv"):
    """The name of a part's file, as a column over ``part``."""
    return F.concat(F.lit(f"{base}_part"), F.col("part").cast("string"), F.lit(suffix))


def part_manifest(
    parts: DataFrame, base: str, suffix: str = ".csv", key: str | None = None
) -> DataFrame:
    """part, name and number of rows of every part, and its first and last ``key``."""
    shown = [F.count(F.lit(1)).alias("n")]
    if key:
        shown.append(F.min_by(key, "row_in_part").alias("first_key"))
        shown.append(F.max_by(key, "row_in_part").alias("last_key"))
    return parts.groupBy("part").agg(*shown).withColumn("name", part_name(base, suffix))


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """The file that holds each part below ``path``, as written by ``write_parts``: name and file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return found.select("name", F.col("path").alias("file"))


def write_parts(parts: DataFrame, path: str, base: str) -> None:
    """Write each part as one CSV file with a header, in ``path/name=<base>_part<n>.csv``."""
    (
        parts.withColumn("name", part_name(base))
        .repartitionByRange("part")
        .sortWithinPartitions("name", "row_in_part")
        .drop("part", "row_in_part")
        .write.partitionBy("name")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", 0)
        .csv(path)
    )
