"""CSV records that may span lines, found without reading a file in one task.

Whether a line starts a record depends on the quotes before it. Their parity is
counted per file block, summed over the blocks of a file, and carried into each
block, so every block is worked on by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.plans import stage

_LINE_BREAK = "\n"


def largest_file(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of the largest file; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return int(files.agg(F.max("length").alias("bytes")).first()["bytes"] or 0)


def quote_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The ``quotes`` of each ``file``, whether any line has an odd number (``spanning``) or a carriage return inside (``returns``).

    One pass, summed in the tasks that read.
    """
    lines = spark.read.option("lineSep", _LINE_BREAK).text(path)
    quotes = _quotes(F.col("value"))
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.sum(quotes).alias("quotes"), F.max(quotes % 2 == 1).alias("spanning"),
        F.max(F.col("value").rlike(r"\r[^\n]")).alias("returns"),
    )


def records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(source_order, text) of the first record of each file, and of all others.

    Every quoted field of the files closes (``quote_counts``).
    """
    lines = spark.read.option("lineSep", _LINE_BREAK).text(path)
    return records_of(
        staged_lines(lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))
    )


def staged_lines(lines: DataFrame) -> DataFrame:
    """``value, file, block`` as read, written with the place and the number of quotes of each line."""
    row = F.monotonically_increasing_id().alias("row")
    return stage(lines.select("file", "block", row, "value", _quotes(F.col("value")).alias("quotes")), "lines")


def records_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``records`` of ``staged_lines``."""
    by_file = Window.partitionBy("file").orderBy("block")  # one row per block
    earlier_blocks = by_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("total"))
    blocks = blocks.withColumn("carried", F.coalesce(F.sum("total").over(earlier_blocks), F.lit(0)))

    in_block = Window.partitionBy("file", "block").orderBy("row")
    earlier_lines = in_block.rowsBetween(Window.unboundedPreceding, -1)
    up_to_here = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.sum("quotes").over(earlier_lines), F.lit(0))
    opened = lines.join(blocks.select("file", "block", "carried"), ["file", "block"])
    opened = opened.withColumn("opens", (F.col("carried") + before) % 2 == 0)
    start = F.when(F.col("opens"), F.struct("block", "row"))
    opened = opened.withColumn("start", F.max(start).over(up_to_here))

    # Lines ahead of a block's first record belong to the last one before it.
    last = opened.groupBy("file", "block").agg(F.max("start").alias("last"))
    last = last.withColumn("earlier", F.max("last").over(earlier_blocks)).drop("last")
    owned = opened.join(last, ["file", "block"]).withColumn(
        "start", F.coalesce("start", "earlier")
    )
    pieces = F.sort_array(F.collect_list(F.struct("block", "row", "value")))
    text = F.array_join(F.transform(pieces, lambda p: p["value"]), _LINE_BREAK)
    joined = owned.groupBy("file", "start").agg(F.regexp_replace(text, r"\r\z", "").alias("text"))
    order = F.struct("file", F.col("start.block").alias("block"), F.col("start.row").alias("row"))
    found = joined.select(order.alias("source_order"), "text")

    firsts = lines.groupBy("file").agg(F.min(F.struct("block", "row")).alias("first"))
    firsts = firsts.select(F.struct("file", "first.block", "first.row").alias("source_order"))
    headers = found.join(firsts, "source_order", "left_semi")
    rest = found.join(firsts, "source_order", "left_anti").filter("text <> ''")
    return headers, rest


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
