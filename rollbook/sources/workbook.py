"""Workbooks (XLSX) as rows, for loads of small files.

Spark spreads the files; inside one file, whose sheets the format limits to
about a million rows, a task reads row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import header_column
from rollbook.sources import xlsx
from rollbook.sources.xlsx import CELL_RULES, read_workbook

ROW_SCHEMA = (
    "file string, sheet string, sheet_no int, row_no int, data_row long, header array<string>, "
    "cells array<string>, numeric array<boolean>"
)
_BATCH_ROWS = 10_000

# Tasks get these helpers with the function that uses them, so that workers need
# no copy of the package.
cloudpickle.register_pickle_by_value(xlsx)


def workbook_rows(
    spark: SparkSession, path: str | list[str], rule: str = "a", sheets: str = "first"
) -> DataFrame:
    """Rows of all workbooks below ``path``; see ``parse_workbooks``."""
    files = spark.read.format("binaryFile").load(path)
    return parse_workbooks(files.select("path", "content"), rule, sheets)


def parse_workbooks(files: DataFrame, rule: str = "a", sheets: str = "first") -> DataFrame:
    """Rows of workbooks given as (path, content).

    One output row per data row of the first sheet or of ``sheets="all"``:
    file, sheet, sheet_no, row_no, data_row (counted over the sheets of a file),
    the sheet's header, the cells as text, as many as the header has, and which
    of them are numbers. A filled cell beyond the header is an error. The cell rules differ in how they show formulas,
    rich text, links and blanks; rule ``d`` gives null for blanks, others ''.
    """
    if rule not in CELL_RULES:
        raise ValueError(f"unknown cell rule {rule!r}; use one of {sorted(CELL_RULES)}")
    if sheets not in ("first", "all"):
        raise ValueError("sheets must be 'first' or 'all'")

    fields = T.StructType.fromDDL(ROW_SCHEMA).fields

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [field.name for field in fields]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for row in read_workbook(path, content, CELL_RULES[rule], sheets == "all"):
                    rows.append(row)
                    if len(rows) == _BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(read, ROW_SCHEMA)


def rows_to_table(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Bind cells to ``schema`` by position; a wrong number of cells is an error."""
    width = len(schema.fields)
    cells = F.when(F.size("cells") == width, F.col("cells")).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of cells in "), F.col("file")))
    )
    return rows.withColumn("_cells", cells).select(
        *[F.col("_cells")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)],
        F.struct("file", "sheet_no", "row_no").alias("source_order"),
    )


def rows_by_name(
    rows: DataFrame,
    allowed: Sequence[str],
    rule: str = "trim_lower",
    on_unknown: str = "fail",
) -> DataFrame:
    """Allowed columns by header name, per file; absent ones become null.

    A file without any allowed column is an error, and so is an unknown column
    unless ``on_unknown`` is ``"drop"``.
    """
    if on_unknown not in ("fail", "drop"):
        raise ValueError("on_unknown must be 'fail' or 'drop'")
    names = F.transform("header", lambda h: header_column(h, rule))
    wanted = F.array(*[F.lit(a) for a in allowed])
    usable = F.arrays_overlap("_names", wanted)
    if on_unknown == "fail":
        usable = usable & (F.size(F.array_except("_names", wanted)) == 0)
    found = F.array_join("_names", ", ")
    failure = F.concat(F.lit("columns not allowed in "), F.col("file"), F.lit(": "), found)
    checked = F.when(usable, F.col("_names")).otherwise(F.raise_error(failure))

    def cell(name: str) -> Column:
        position = F.nullif(F.array_position("_names", F.lit(name)), F.lit(0))
        return F.try_element_at("cells", position.cast("int")).alias(name)

    return (
        rows.withColumn("_names", names)
        .withColumn("_names", checked)
        .select(
            *[cell(a) for a in allowed],
            F.struct("file", "sheet_no", "row_no").alias("source_order"),
        )
    )
