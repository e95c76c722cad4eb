"""Listings: key lookups, lookup joins, ordered pages with totals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.typed import leading_int_of
from rollbook.plans import all_terms, number_rows, order_columns, rows_at, rows_between
from rollbook.plans.ordering import Term

DEFAULT_PAGE = 1
DEFAULT_LIMIT = 10

# Every task of the scan hands this many rows at most to the one that cuts the page.
FEW_ROWS = 100

# Keys of a page up to this size are broadcast.
PAGE_BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Lookup:
    """A table joined to a listing by a key that is unique in it."""

    table: DataFrame
    on: str
    key: str
    columns: dict[str, str] = field(default_factory=dict)
    how: str = "left"


@dataclass(frozen=True)
class Page:
    """One page of rows and a one-row summary, from the same input."""

    page: int
    limit: int
    rows: DataFrame
    summary: DataFrame

    def with_totals(self) -> DataFrame:
        """The rows, each with the page's totals."""
        total, pages = self._totals()
        return self.rows.withColumns({"total": total, "pages": pages})

    def envelope(self) -> DataFrame:
        """One row: page, limit, total, pages and the rows as an ordered array."""
        return self.summary.withColumn("data", ordered_array(self.rows).scalar())

    def _totals(self) -> tuple[Column, Column]:
        return self.summary.select("total").scalar(), self.summary.select("pages").scalar()


def page_args(page: object = None, limit: object = None) -> tuple[int, int]:
    """Page arguments from request text: missing, zero or text give 1 and 10."""
    return (
        _positive(page, DEFAULT_PAGE, "page"),
        _positive(limit, DEFAULT_LIMIT, "limit"),
    )


def by_key(df: DataFrame, key: str, values: DataFrame | Sequence[object]) -> DataFrame:
    """Rows whose key is in ``values``, a list or a one-column table of any size."""
    if not isinstance(values, DataFrame):
        return df.filter(F.col(key).isin(list(values)))
    wanted = values.select(F.col(values.columns[0]).alias(key)).distinct()
    return df.join(wanted, key, "left_semi")


def with_lookups(fact: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """``fact`` with renamed columns from each lookup table.

    Lookup keys are unique, so only the fact side of a join can be skewed, which
    adaptive execution splits. No side is broadcast by hint.
    """
    out = fact
    for number, lookup in enumerate(lookups):
        joined_key = f"_lookup_{number}"
        side = lookup.table.select(
            F.col(lookup.key).alias(joined_key),
            *[F.col(c).alias(alias) for c, alias in lookup.columns.items()],
        )
        out = out.join(side, F.col(lookup.on) == F.col(joined_key), lookup.how).drop(joined_key)
    return out


def page(
    df: DataFrame,
    order: Sequence[Term],
    key: str | Sequence[str],
    page: object = None,
    limit: object = None,
    counted: DataFrame | None = None,
) -> Page:
    """One page of ``df`` by ``order`` then ``key``.

    ``counted`` is the frame whose rows make the total, if that is not ``df``.
    """
    number, size = page_args(page, limit)
    return Page(
        number,
        size,
        _cut(df, order, key, number, size),
        _summary(counted if counted is not None else df, number, size),
    )


def lookup_page(
    fact: DataFrame,
    lookups: Sequence[Lookup],
    order: Sequence[Term],
    key: str | Sequence[str],
    page: object = None,
    limit: object = None,
    total: str = "base",
) -> Page:
    """A page of ``with_lookups``, ordered by columns of ``fact``.

    Inner lookups only filter before the cut; their columns, and the left
    lookups, are joined to the rows of the page alone. ``total="base"`` counts
    the fact table, ``"joined"`` only the rows a page can reach.
    """
    if total not in ("base", "joined"):
        raise ValueError("total must be 'base' or 'joined'")
    reachable = fact
    for lookup in lookups:
        if lookup.how == "inner":
            known = lookup.table.select(F.col(lookup.key).alias("_known"))
            reachable = reachable.join(known, F.col(lookup.on) == F.col("_known"), "left_semi")
    number, size = page_args(page, limit)
    columns = order_columns(order, key)
    rows = with_lookups(_cut(reachable, order, key, number, size), lookups).orderBy(*columns)
    counted = fact if total == "base" else reachable
    return Page(number, size, rows, _summary(counted, number, size))


def all_pages(
    df: DataFrame, order: Sequence[Term], key: str | Sequence[str], limit: object = None
) -> DataFrame:
    """Every row with its ``page_no`` and ``position`` on the page, from 1."""
    _, size = page_args(None, limit)
    numbered = number_rows(df, order_columns(order, key), "_ordinal", unique=True)
    return numbered.withColumns(
        {
            "page_no": F.floor(F.col("_ordinal") / F.lit(size)) + F.lit(1),
            "position": F.col("_ordinal") % F.lit(size) + F.lit(1),
        }
    ).drop("_ordinal")


def single_value(df: DataFrame, column: str, default: str = "") -> DataFrame:
    """One row: ``column`` of any one row, or ``default`` if it is null or there is none."""
    one = df.select(column).limit(1).agg(F.first(column).alias(column))
    return one.select(F.coalesce(F.col(column), F.lit(default)).alias(column))


def ordered_array(rows: DataFrame) -> DataFrame:
    """One row whose ``data`` holds the rows of one ordered page as structs."""
    placed = rows.select(
        F.monotonically_increasing_id().alias("at"), F.struct(*rows.columns).alias("row")
    )
    items = F.array_sort(F.collect_list(F.struct("at", "row")))
    return placed.agg(F.transform(items, lambda item: item["row"]).alias("data"))


def _cut(
    df: DataFrame, order: Sequence[Term], key: str | Sequence[str], number: int, size: int
) -> DataFrame:
    """One page. Beyond the first rows, counts of ranges find it, or a sort where a column has no ranges."""
    offset, last = (number - 1) * size, number * size
    columns = order_columns(order, key)
    if last <= FEW_ROWS:
        return df.orderBy(*columns).offset(offset).limit(size)
    terms = [t if isinstance(t, tuple) else (t, "asc") for t in all_terms(order, key)]
    values = [(F.col(v) if isinstance(v, str) else v, direction) for v, direction in terms]
    found = rows_at(df, values, offset, last)
    if found is None:
        found = _sorted_out(df, values, key, offset, last)
    return found.orderBy(*columns)


def _sorted_out(
    df: DataFrame, values: Sequence[tuple[Column, str]], key: str | Sequence[str], offset: int, last: int
) -> DataFrame:
    """The rows of a page by a parallel sort of all order values and keys."""
    keys = [key] if isinstance(key, str) else list(key)
    narrow = df.select(
        *[v.alias(f"_order_{i}") for i, (v, _) in enumerate(values)],
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
    )
    sort = order_columns([(f"_order_{i}", direction) for i, (_, direction) in enumerate(values)])
    found = rows_between(narrow, sort, offset, last).select(*[f"_key_{i}" for i in range(len(keys))])
    if last - offset <= PAGE_BROADCAST_ROWS:
        found = F.broadcast(found)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return df.join(found, same, "left_semi")


def _summary(counted: DataFrame, number: int, size: int) -> DataFrame:
    total = F.count(F.lit(1))
    return counted.agg(
        F.lit(number).cast("long").alias("page"),
        F.lit(size).cast("long").alias("limit"),
        total.alias("total"),
        F.ceil(total / F.lit(size)).alias("pages"),
    )


def _positive(value: object, default: int, name: str) -> int:
    parsed = leading_int_of(value) or default
    if parsed < 0:
        raise ValueError(f"{name} must not be negative, got {parsed}")
    return parsed
