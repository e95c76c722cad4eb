"""Sort specifications with a stated null order.

The registry's database puts nulls last when ascending and first when
descending; Spark does the opposite, so no sort here relies on a default.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Term = str | Column | tuple[str | Column, str]


def order_columns(order: Iterable[Term], key: str | Sequence[str] = ()) -> list[Column]:
    """Sort columns for ``order``, with every key column appended as tie-break."""
    return [_sort_column(t) for t in all_terms(order, key)]


def all_terms(order: Iterable[Term], key: str | Sequence[str] = ()) -> list[Term]:
    """The terms of ``order`` and the key columns that are not among them."""
    terms = list(order)
    named = {t if isinstance(t, str) else t[0] for t in terms if _is_named(t)}
    keys = [key] if isinstance(key, str) else list(key)
    return terms + [k for k in keys if k not in named]


def _is_named(term: Term) -> bool:
    return isinstance(term, str) or (isinstance(term, tuple) and isinstance(term[0], str))


def _sort_column(term: Term) -> Column:
    value, direction = term if isinstance(term, tuple) else (term, "asc")
    column = F.col(value) if isinstance(value, str) else value
    if direction == "asc":
        return column.asc_nulls_last()
    if direction == "desc":
        return column.desc_nulls_first()
    raise ValueError(f"order direction must be 'asc' or 'desc', got {direction!r}")
