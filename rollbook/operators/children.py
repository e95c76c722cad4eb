"""Parents with a page of their children, for one parent or for all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.predicates import eq_ci, matches
from rollbook.operators.change import dedupe_by_key
from rollbook.operators.listing import ordered_array, page, page_args
from rollbook.plans import all_terms, order_columns, rank_in_group, run_of_each_group
from rollbook.plans.ordering import Term

# Spark cuts a ranked group to its first rows before the shuffle up to this many.
EARLY_CUT_ROWS = 1_000


def children_page(
    parent: DataFrame,
    child: DataFrame,
    parent_id: str,
    parent_key: str,
    child_fk: str,
    order: Sequence[Term],
    child_key: str,
    terms: Sequence[tuple[str, str]] = (),
    q: str = "",
    page_no: object = None,
    limit: object = None,
    parent_columns: Sequence[str] = (),
    child_columns: Sequence[str] = (),
) -> DataFrame:
    """One row: the parent, totals and one page of its children as an array.

    Keys match without regard to case. No row comes back for an unknown parent;
    if several parents share a folded key, the smallest key is taken.
    """
    wanted = F.lit(parent_id)
    found = parent.filter(eq_ci(F.col(parent_key), wanted)).orderBy(parent_key).limit(1)
    mine = child.filter(eq_ci(F.col(child_fk), wanted))
    if terms:
        mine = mine.filter(matches(terms, q))
    cut = page(mine, order, child_key, page_no, limit)
    data = cut.rows.select(*(child_columns or child.columns))
    summary = cut.summary
    return found.select(
        *(parent_columns or parent.columns),
        F.lower(wanted).alias("parent_id"),
        summary.select("total").scalar().alias("total"),
        summary.select("pages").scalar().alias("pages"),
        F.lit(cut.page).cast("long").alias("page"),
        F.lit(cut.limit).cast("long").alias("limit"),
        ordered_array(data).scalar().alias("data"),
    )


def children_pages(
    parent: DataFrame,
    child: DataFrame,
    parent_key: str,
    child_fk: str,
    order: Sequence[Term],
    child_key: str,
    terms: Sequence[tuple[str, str]] = (),
    q: str = "",
    page_no: object = None,
    limit: object = None,
    parent_columns: Sequence[str] = (),
    child_columns: Sequence[str] = (),
) -> DataFrame:
    """The same page for every parent, one row per folded parent key.

    Totals are pre-aggregated counts. Of a page near the front each task keeps only the first rows of
    a parent before the shuffle; for others the ranges of the order that hold the page are found by
    counting, and only their rows travel. So a parent with very many children is never gathered in one task.
    """
    number, size = page_args(page_no, limit)
    folded = "parent_id"
    parents = dedupe_by_key(
        parent.withColumn(folded, F.lower(F.col(parent_key))), [folded], [parent_key]
    ).filter(F.col(folded).isNotNull())
    mine = child.withColumn(folded, F.lower(F.col(child_fk))).filter(F.col(folded).isNotNull())
    if terms:
        mine = mine.filter(matches(terms, q))

    totals = mine.groupBy(folded).agg(F.count(F.lit(1)).alias("_total"))
    ranked = _page_of_each(mine, folded, all_terms(order, child_key), number, size)
    shown = F.struct(*(child_columns or child.columns)).alias("row")
    rows = ranked.select(folded, F.struct("_rank", shown).alias("item"))
    data = rows.groupBy(folded).agg(F.array_sort(F.collect_list("item")).alias("_items"))

    total = F.coalesce(F.col("_total"), F.lit(0))
    items = F.coalesce(F.transform("_items", lambda item: item["row"]), F.array())
    return (
        parents.join(totals, folded, "left")
        .join(data, folded, "left")
        .select(
            *(parent_columns or parent.columns),
            folded,
            total.alias("total"),
            F.ceil(total / F.lit(size)).alias("pages"),
            F.lit(number).cast("long").alias("page"),
            F.lit(size).cast("long").alias("limit"),
            items.alias("data"),
        )
    )


def _page_of_each(mine: DataFrame, folded: str, terms: list[Term], number: int, size: int) -> DataFrame:
    offset, last = (number - 1) * size, number * size
    if last < EARLY_CUT_ROWS:
        window = Window.partitionBy(folded).orderBy(*order_columns(terms))
        ranked = mine.withColumn("_rank", F.row_number().over(window))
    else:
        pairs = [t if isinstance(t, tuple) else (t, "asc") for t in terms]
        columns = [(F.col(c) if isinstance(c, str) else c, d) for c, d in pairs]
        found = run_of_each_group(mine, folded, columns, offset, last, "_rank")
        if found is not None:
            return found
        ranked = rank_in_group(mine, [folded], order_columns(terms), "_rank", unique=True)
    return ranked.filter((F.col("_rank") > offset) & (F.col("_rank") <= last))
