"""Exact row numbers without gathering a table or a large group in one task.

Rows are range-partitioned by their full order, so even one group that holds a
third of the table is spread over many tasks. The sorted rows are written once
with their task and their position in it; only the row counts per task are
needed to turn positions into numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.plans.sizing import hint_by_size
from rollbook.plans.staging import stage

# Beyond this many rows a group is ranked over several tasks.
LARGE_GROUP_ROWS = 1_000_000

_TASK = "_task"
_POSITION = "_position"
_TIE = "_tie"
_POSITION_BITS = 33  # monotonically_increasing_id keeps the row in its low 33 bits
_TASKS_TOGETHER = 1024  # tasks whose row counts are summed first


def with_source_order(df: DataFrame, out: str = "source_order") -> DataFrame:
    """Add a sortable column that follows the order of rows in the source files.

    The column is a struct of file, block and row; frames that are not file
    scans are ordered by partition and have no file. No shuffle takes place, so
    the column must be added at the scan.
    """
    row = F.monotonically_increasing_id().alias("row")
    if _reads_files(df):
        file = F.col("_metadata.file_path").alias("file")
        block = F.col("_metadata.file_block_start").alias("block")
    else:
        file = F.lit("").alias("file")
        block = F.spark_partition_id().cast("long").alias("block")
    return df.select("*", F.struct(file, block, row).alias(out))


def number_rows(
    df: DataFrame,
    order: Sequence[Column] | None = None,
    out: str = "ordinal",
    unique: bool = False,
    scanned: bool = False,
) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... over the whole table.

    With ``order`` the rows are numbered in that order; without, in the order of
    the files they were read from, without a shuffle. Without an order it is an
    error if ``df`` does not read files or was shuffled after its scan. Say so if the order is ``unique`` or ``df`` is read
    from files without a shuffle (``scanned``): either saves a sort.
    """
    if order is None:
        return _numbered_by_source(df, out)
    return _shifted(_placed(df, order, unique or scanned, unique), _together(), [_TASK], out)


def rows_between(df: DataFrame, order: Sequence[Column], first: int, last: int) -> DataFrame:
    """The rows numbered ``first`` to ``last - 1`` in a unique ``order``, in no order.

    ``df`` is written in order; then only what the tasks with such rows have
    written is read. The number of those tasks is at most that of the rows.
    """
    rows = _placed(df, order, True, True)
    starts = _starts(rows, _together(), [_TASK])
    hit = starts.filter((F.col("start") < last) & (F.col("start") + F.col("n") > first)).collect()
    shift = F.lit(None).cast("long")
    for run in hit:
        shift = F.when(F.col(_TASK) == run[_TASK], F.lit(run["_shift"])).otherwise(shift)
    number = F.col(_POSITION) + shift
    mine = rows.filter(F.col(_TASK).isin([run[_TASK] for run in hit]))
    return mine.filter((number >= first) & (number < last)).drop(_TASK, _POSITION)


def _together() -> Column:
    return F.floor(F.col(_TASK) / F.lit(_TASKS_TOGETHER))


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    out: str = "rank",
    unique: bool = False,
    largest: int | None = None,
    large: int = LARGE_GROUP_ROWS,
) -> DataFrame:
    """Add ``out`` = 1, 2, 3, ... inside each group.

    While every group is small, an ordinary window ranks them; otherwise ranks
    are derived from the range-partitioned order, in which a large group spans
    many tasks. Unless the size of the ``largest`` group (or a bound) is given,
    it is counted, with map-side combine.
    """
    if largest is None:
        largest = largest_group(df, group)
    if largest <= large:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(out, F.row_number().over(window).cast("long"))

    rows = _placed(df, [*(F.col(g).asc_nulls_last() for g in group), *order], unique, unique)
    runs = rows.groupBy(_TASK, *group).agg(
        F.count(F.lit(1)).alias("_run"), F.min(_POSITION).alias("_first")
    )
    earlier = (
        Window.partitionBy(*group).orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
    )  # at most one row per writing task and group
    runs = runs.withColumn("_before", F.coalesce(F.sum("_run").over(earlier), F.lit(0)))
    joined = rows.alias("r").join(
        runs.alias("s"),
        _all(
            [F.col(f"r.{_TASK}") == F.col(f"s.{_TASK}")]
            + [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
        ),
    )
    rank = F.col("s._before") + F.col(f"r.{_POSITION}") - F.col("s._first") + F.lit(1)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], rank.alias(out))


def next_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    largest: int | None = None,
    large: int = LARGE_GROUP_ROWS,
) -> DataFrame:
    """Add ``out``: the nearest non-null ``value`` of a later row of the group.

    ``order`` names columns without nulls whose ascending order is unique in a
    group. A group of more than ``large`` rows spans many tasks: each looks at its own
    rows, and a row without a value after it takes the first one of a later task.
    """
    if largest is None:
        largest = largest_group(df, group)
    df = df.withColumn("_value", value)
    backwards = [F.col(c).desc() for c in order]
    if largest <= large:
        later = Window.partitionBy(*group).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.last("_value", ignorenulls=True).over(later)).drop("_value")
    rows = _placed(df, [*(F.col(g).asc_nulls_last() for g in group), *(F.col(c).asc() for c in order)], True, True)
    in_task = Window.partitionBy(_TASK, *group).orderBy(F.col(_POSITION).desc())
    later = in_task.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(later))
    given = F.when(F.col("_value").isNotNull(), F.struct(_POSITION, "_value"))
    firsts = rows.groupBy(_TASK, *group).agg(F.min(given)["_value"].alias("_first"))
    tasks = Window.partitionBy(*group).orderBy(F.col(_TASK).desc())  # one row per writing task
    firsts = firsts.withColumn(
        "_ahead", F.last("_first", ignorenulls=True).over(tasks.rowsBetween(Window.unboundedPreceding, -1))
    )
    joined = rows.alias("r").join(
        firsts.alias("s"),
        _all(
            [F.col(f"r.{_TASK}") == F.col(f"s.{_TASK}")]
            + [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
        ),
    )
    columns = [F.col(f"r.{c}") for c in df.columns if c != "_value"]
    return joined.select(*columns, F.coalesce("r._own", "s._ahead").alias(out))


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group."""
    sizes = df.groupBy(*group).count()
    return int(sizes.agg(F.max("count").alias("n")).first()["n"] or 0)


def _placed(
    df: DataFrame, order: Sequence[Column], repeatable: bool, unique: bool
) -> DataFrame:
    """``df`` written in order, with the task and position of every row."""
    keys = list(order)
    if not unique:
        # Equal rows must not meet in one range, so their place in the input is
        # a further key. Unless it is ``repeatable``, the input is sorted first:
        # a task that runs again must give its rows the same places.
        if not repeatable:
            df = df.sortWithinPartitions(*keys, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        df = df.withColumn(_TIE, F.monotonically_increasing_id())
        keys.append(F.col(_TIE).asc())
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_TIE)
    return stage(ordered.withColumns(_place()), "placed")


def _place() -> dict[str, Column]:
    place = F.monotonically_increasing_id()
    return {
        _TASK: F.shiftright(place, _POSITION_BITS).cast("int"),
        _POSITION: place.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
    }


def _numbered_by_source(df: DataFrame, out: str) -> DataFrame:
    if not _reads_files(df):
        raise ValueError("only rows read from files have a source order; give an order")
    located = with_source_order(df, "_source").withColumns(
        {"_file": F.col("_source.file"), "_block": F.col("_source.block"), **_place()}
    )
    rows = stage(located.drop("_source"), "placed")
    # The rows of a file block are read in one run by one task; if not, the
    # frame was shuffled after its scan.
    blocks = rows.groupBy("_file", "_block").agg(
        (F.max(_TASK) > F.min(_TASK)).alias("dealt"),
        (F.max(_POSITION) - F.min(_POSITION) + F.lit(1) > F.count(F.lit(1))).alias("gaps"),
    )
    if not blocks.filter("dealt OR gaps").isEmpty():
        raise ValueError("rows were shuffled after their scan; add a source order at the scan")
    return _shifted(rows.drop(_TASK), F.col("_file"), ["_file", "_block"], out)


def _shifted(rows: DataFrame, outer: Column, place: list[str], out: str) -> DataFrame:
    """Positions within each task or file block turned into numbers."""
    shifts = _starts(rows, outer, place).select(*place, "_shift")
    numbered = rows.join(hint_by_size(shifts)(shifts), place)
    return numbered.withColumn(out, F.col(_POSITION) + F.col("_shift")).drop(
        *[c for c in (_TASK, "_file", "_block", _POSITION, "_shift") if c in numbered.columns]
    )


def _starts(rows: DataFrame, outer: Column, place: list[str]) -> DataFrame:
    """The number of each place's first row, its rows, and what turns positions into numbers.

    The rows before a place are those of earlier ``outer`` groups and of earlier
    places in its own group: sums in two levels over one short row per place.
    """
    runs = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min(_POSITION).alias("first"))
    runs = stage(runs.withColumn("_outer", outer), "runs")
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = runs.groupBy("_outer").agg(F.sum("n").alias("n"))
    groups = groups.select("_outer", F.sum("n").over(ahead.orderBy("_outer")).alias("_groups"))
    own = ahead.partitionBy("_outer").orderBy(*place)
    runs = runs.withColumn("_before", F.sum("n").over(own)).join(groups, "_outer")
    start = F.coalesce("_groups", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return stage(runs.select(*place, "n", start.alias("start"), (start - F.col("first")).alias("_shift")), "starts")


def _reads_files(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path").schema  # resolves the metadata column
    except AnalysisException:
        return False
    return True


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result
