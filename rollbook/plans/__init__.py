"""Plan building blocks shared by the operators."""

from rollbook.plans.group_ranges import run_of_each_group
from rollbook.plans.histogram import rows_at
from rollbook.plans.ordering import all_terms, order_columns
from rollbook.plans.ranking import (
    largest_group,
    next_in_group,
    number_rows,
    rank_in_group,
    rows_between,
    with_source_order,
)
from rollbook.plans.sizing import hint_by_size, is_small, measured_bytes, parts_by_size
from rollbook.plans.staging import release, stage, stage_path

__all__ = [
    "all_terms",
    "hint_by_size",
    "is_small",
    "largest_group",
    "measured_bytes",
    "next_in_group",
    "number_rows",
    "order_columns",
    "parts_by_size",
    "rank_in_group",
    "release",
    "rows_at",
    "rows_between",
    "run_of_each_group",
    "stage",
    "stage_path",
    "with_source_order",
]
