"""Files that arrive in a folder, each merged into a table once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.sources.csv import parse_lines
from rollbook.sources.store import ROWS_PER_RANGE, merge, read_ranges

# Files of one batch.
FILES_PER_BATCH = 1_000

_ORDER = "_source_order"


def ingest_dir(
    spark: SparkSession,
    in_dir: str,
    schema: T.StructType,
    keys: Sequence[str],
    update_cols: Sequence[str],
    table_dir: str,
    checkpoint: str,
    sep: str = ",",
    normalise: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Upsert every new CSV file of ``in_dir`` into the table by key range at ``table_dir``; gives the table.

    Runs until no new file is left. Spark's file source reads the lines of at most
    ``files_per_batch`` arrived files, with their files and blocks as order, and its log knows which have been taken; no
    list of files passes the driver's code. Within a batch the first row per key in source order wins. A bad file fails
    its batch before the table is changed. A batch that is repeated after a failure
    merges the same rows again, which changes nothing.
    """
    reader = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(in_dir).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )

    def arrived(batch: DataFrame, number: int) -> None:
        rows = parse_lines(batch, schema, sep, _ORDER)
        if normalise:
            rows = normalise(rows)
        merge(rows, table_dir, keys, update_cols, [_ORDER], rows_per_range)

    query = (
        lines.writeStream.foreachBatch(arrived)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    table = read_ranges(spark, table_dir, schema)
    return spark.createDataFrame([], schema) if table is None else table
