"""CSV loads by position and by name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import header_name
from rollbook.plans import with_source_order
from rollbook.sources.records import largest_file, quote_counts, records, records_of, staged_lines

# Stands for a quoted empty field while Spark turns unquoted ones into null.
_QUOTED_EMPTY = "\x01\x02"

# A file up to this size may be read by one task.
ONE_TASK_BYTES = 256 * 1024 * 1024


def load_positional(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = ",",
    spanning: bool | None = None,
    source_order: str | None = None,
    one_task_bytes: int | None = None,
) -> DataFrame:
    """Rows of CSV files whose fields bind to ``schema`` by position.

    Header names are ignored. A row with too few or too many fields fails the
    whole load, and so does a value of the wrong type in a column that is used.
    A file with a quote that never closes is an error at any size.
    An unquoted empty field is null, a quoted one ''. ``source_order`` names a
    column to add that sorts rows as the files do.

    ``spanning`` says whether quoted fields may hold line breaks; None finds
    out. Files of any size are read by many tasks either way. Rows come in no
    order of their own: ask for a ``source_order`` to number them.
    """
    rows = _rows(spark, path, schema, sep, spanning, source_order, None, one_task_bytes)
    return restore_empty(rows)


def load_by_name(
    spark: SparkSession,
    path: str | list[str],
    allowed: Sequence[str],
    on_unknown: str = "fail",
    sep: str | None = None,
    spanning: bool | None = None,
    source_order: str | None = None,
) -> DataFrame:
    """Text columns of CSV files whose header names them, in any order and case.

    Allowed columns that are absent become null. A header without any allowed
    column is an error, and so is an unknown column unless ``on_unknown`` is
    ``"drop"``. With several files, every header must equal the first.
    ``spanning`` and ``source_order`` are as in ``load_positional``.
    """
    if on_unknown not in ("fail", "drop"):
        raise ValueError("on_unknown must be 'fail' or 'drop'")
    first = first_line(spark, path)
    sep = sep or delimiter_of(first)
    raw = [name.replace('"', "") for name in first.strip("\ufeff\r").split(sep)]
    names = [header_name(name, "unquote") for name in raw]
    valid = [n for n in names if n in allowed]
    if not valid:
        raise ValueError(f"no allowed column in the header: {names}")
    if len(set(valid)) < len(valid):
        raise ValueError(f"repeated column in the header: {names}")
    unknown = [n for n in names if n not in allowed]
    if unknown and on_unknown == "fail":
        raise ValueError(f"unknown columns in the header: {unknown}")

    schema = T.StructType([T.StructField(n, T.StringType()) for n in raw])
    rows = _rows(spark, path, schema, sep, spanning, source_order, first)
    extra = [source_order] if source_order else []
    positions = {n: i for i, n in enumerate(names)}
    rows = rows.toDF(*[f"_{i}" for i in range(len(names))], *extra)
    return restore_empty(
        rows.select(
            *[
                F.col(f"_{positions[n]}").alias(n)
                if n in positions
                else F.lit(None).cast("string").alias(n)
                for n in allowed
            ],
            *extra,
        )
    )


def load_mixed_by_name(
    spark: SparkSession,
    path: str | list[str],
    allowed: Sequence[str],
    on_unknown: str = "fail",
    source_order: str | None = None,
) -> DataFrame:
    """``load_by_name`` for files that differ in delimiter, column order, case and columns.

    The first line of every file is found in one pass; files with the same one are read together, by
    one reader. Each file's own header decides what is unknown or absent in it. Files without a line have no rows.
    """
    by_header: dict[str, list[str]] = {}
    for row in first_lines(spark, path).collect():  # as many as files, which Spark lists on the driver, too
        by_header.setdefault(row["header"], []).append(row["file"])
    if not by_header:
        raise ValueError(f"no lines in {path}")
    loads = [
        load_by_name(spark, sorted(files), allowed, on_unknown, source_order=source_order)
        for _, files in sorted(by_header.items())
    ]
    return reduce(DataFrame.unionByName, loads)


def first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file`` and ``header``, its first line, of each file that has one."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"),
        "value",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = F.min(F.struct("row", "value"))["value"]
    # A list beside it, always empty, lets Spark keep one line for each file in a hash map; the text alone makes it sort all lines.
    none = F.collect_list(F.lit(None).cast("boolean"))
    starts = lines.filter("block = 0").groupBy("file").agg(first.alias("header"), none.alias("none"))
    return starts.filter(F.size("none") == 0).select("file", F.regexp_replace("header", r"\r\z", "").alias("header"))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of a file, judged by its first line."""
    return delimiter_of(first_line(spark, path))


def delimiter_of(line: str) -> str:
    """``;`` if the line has one, else tab, else comma; quotes are not looked at."""
    for sep in (";", "\t"):
        if sep in line:
            return sep
    return ","


def first_line(spark: SparkSession, path: str | list[str]) -> str:
    """The first line of a file; '' if it has none."""
    row = spark.read.text(path).first()
    return row["value"].rstrip("\r\n") if row else ""


def parse_lines(lines: DataFrame, schema: T.StructType, sep: str, source_order: str) -> DataFrame:
    """Rows as ``load_positional`` gives them, of lines that were read with their ``file`` and ``block``.

    For lines of a stream's batch. A file's first record is its header.
    """
    lines = staged_lines(lines)
    files = lines.groupBy("file").agg(F.sum("quotes").alias("quotes"), F.max(F.col("quotes") % 2 == 1).alias("spanning"))
    _fail_if_open(files)
    if files.filter("spanning").isEmpty():
        order = F.struct("file", "block", "row")
        headers = lines.groupBy("file").agg(F.min(order).alias("source_order")).select("source_order")
        text = F.regexp_replace("value", r"\r\z", "").alias("text")
        rest = lines.select(order.alias("source_order"), text).join(headers, "source_order", "left_anti").filter("text <> ''")
    else:
        _, rest = records_of(lines)
    return restore_empty(_parsed(rest, schema, _options(sep), source_order))


def unclosed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``file`` and whether a quoted field in it is ``unclosed``.

    A quote inside a field is doubled, so a file whose quotes all close has an
    even number of them.
    """
    counts = quote_counts(spark, path)
    return counts.select("file", (F.col("quotes") % 2 == 1).alias("unclosed"))


def restore_empty(df: DataFrame) -> DataFrame:
    """Quoted empty fields as ''."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: F.when(F.col(c) == _QUOTED_EMPTY, F.lit("")).otherwise(F.col(c)) for c in texts}
    )


def _rows(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str,
    spanning: bool | None,
    source_order: str | None,
    header: str | None,
    one_task_bytes: int | None = None,
) -> DataFrame:
    """Parsed rows; with ``header`` every file must have that first line."""
    options = _options(sep)
    bound = ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes
    broken, returns = _line_breaks(spark, path)
    if broken and spanning is False:
        raise ValueError("a quoted field holds a line break, which spanning=False excludes")
    spanning = broken if spanning is None else spanning
    # Spark takes a carriage return alone for a line's end or not, depending on how it reads a file.
    whole = spanning and not returns and largest_file(spark, path) <= bound
    if not whole and spanning:
        return _assembled(spark, path, schema, options, source_order, header)
    rows = (
        spark.read.schema(schema)
        .options(**options, header=True, multiLine=whole, enforceSchema=header is None)
        .csv(path)
    )
    return with_source_order(rows, source_order) if source_order else rows


def _line_breaks(spark: SparkSession, path: str | list[str]) -> tuple[bool, bool]:
    """Whether quoted fields may hold line breaks, and whether any is a carriage return alone.

    It is an error if a quoted field never closes.
    """
    open_file = F.when(F.col("quotes") % 2 == 1, F.col("file"))
    found = quote_counts(spark, path).agg(
        F.min(open_file).alias("file"), F.max("spanning").alias("spanning"), F.max("returns").alias("returns")
    ).first()
    if found["file"] is not None:
        raise ValueError(f"unterminated quoted field in {found['file']}")
    return bool(found["spanning"] or found["returns"]), bool(found["returns"])


def _assembled(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    options: dict[str, str],
    source_order: str | None,
    header: str | None,
) -> DataFrame:
    headers, rest = records(spark, path)
    if header is not None:
        found = F.regexp_replace("text", r"\A\x{FEFF}", "")
        other = headers.filter(found != header.lstrip("\ufeff"))
        if not other.isEmpty():
            raise ValueError(f"a header differs from the first: {header}")
    return _parsed(rest, schema, options, source_order)


def _options(sep: str) -> dict[str, str]:
    return {
        "sep": sep,
        "mode": "FAILFAST",
        "escape": '"',
        "emptyValue": _QUOTED_EMPTY,
        "columnPruning": "false",
    }


def _fail_if_open(files: DataFrame) -> None:
    odd = files.filter("quotes % 2 = 1").head()
    if odd:
        raise ValueError(f"unterminated quoted field in {odd['file']}")


def _parsed(
    rest: DataFrame, schema: T.StructType, options: dict[str, str], source_order: str | None
) -> DataFrame:
    parsed = F.from_csv("text", schema.toDDL(), {**options, "multiLine": "true"})
    rows = rest.select(parsed.alias("row"), "source_order")
    fields = [F.col("row").getField(f.name).alias(f.name) for f in schema.fields]
    order = [F.col("source_order").alias(source_order)] if source_order else []
    return rows.select(*fields, *order)
