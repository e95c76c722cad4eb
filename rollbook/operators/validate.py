"""Row checks that split a batch into good and bad rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import is_given
from rollbook.functions.typed import leading_int, leading_number
from rollbook.plans import stage


@dataclass(frozen=True)
class Rule:
    """A named fault; ``prepare`` adds what its test needs."""

    label: str
    fault: Column
    prepare: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Validation:
    """Rows without faults, and rows with an ``errors`` array."""

    good: DataFrame
    bad: DataFrame


def required(*columns: str) -> list[Rule]:
    """Null and '' are faults; spaces are not."""
    return [Rule(f"{c}: missing", ~is_given(F.col(c))) for c in columns]


def not_greater(a: str, b: str) -> Rule:
    """``a`` must not exceed ``b``; passes unless both start with an integer."""
    fault = leading_number(F.col(a)) > leading_number(F.col(b))
    return Rule(f"{a}: exceeds {b}", fault)


def is_int(column: str) -> Rule:
    """The value must start with an integer."""
    return Rule(f"{column}: not a number", leading_int(F.col(column)).isNull())


def one_of(column: str, values: Sequence[str]) -> Rule:
    """A given value must be in the domain; null is not judged."""
    return Rule(f"{column}: not allowed", ~F.col(column).isin(list(values)))


def exists_in(column: str, parent: DataFrame, key: str) -> Rule:
    """The value must be a key of ``parent``."""
    marker = f"_in_{column}"

    def prepare(df: DataFrame) -> DataFrame:
        known = parent.select(F.col(key).alias(marker)).distinct()
        return df.join(known, F.col(column) == F.col(marker), "left")

    return Rule(f"{column}: not found", F.col(marker).isNull(), prepare)


def validate_rows(df: DataFrame, rules: Sequence[Rule]) -> Validation:
    """Good and bad rows of ``df`` under all rules, judged once and written with their errors."""
    checked = df
    for rule in rules:
        if rule.prepare:
            checked = rule.prepare(checked)
    errors = F.array_compact(F.array(*[F.when(r.fault, F.lit(r.label)) for r in rules]))
    checked = stage(checked.select(*df.columns, errors.alias("errors")), "judged")
    found = F.size("errors")
    return Validation(checked.filter(found == 0).drop("errors"), checked.filter(found > 0))
