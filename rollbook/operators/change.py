"""Changes to tables as pure functions: inserts, upserts and updates.

No function writes. Each gives the table after the change and the affected
rows; ``sources.store`` writes results as versions or merges them by key range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.text import is_given, or_default
from rollbook.plans import hint_by_size, is_small, number_rows, order_columns, stage
from rollbook.plans.ordering import Term
from rollbook.plans.sizing import BROADCAST_BYTES


@dataclass(frozen=True)
class Change:
    """The table after a change, the affected rows and, if asked per request, a status."""

    after: DataFrame
    affected: DataFrame
    status: DataFrame | None = None


def dedupe_by_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Term], keep: str = "first"
) -> DataFrame:
    """The first (or last) row per key by ``order_by``, which is required.

    Spark keeps one row per key and task before the shuffle, so a key with very
    many copies is not gathered in one task.
    """
    if not order_by:
        raise ValueError("dedupe_by_key needs an order to choose among duplicates")
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    columns = order_columns(order_by)
    if keep == "last":
        columns = order_columns([_reversed(t) for t in order_by])
    window = Window.partitionBy(*keys).orderBy(*columns)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def append(
    target: DataFrame,
    rows: DataFrame,
    constants: Mapping[str, object] | None = None,
    defaults: Mapping[str, str] | None = None,
    now: object = None,
    time_columns: Sequence[str] = ("created_at", "updated_at"),
) -> Change:
    """``target`` with ``rows`` added; absent columns become null.

    ``constants`` are set on every new row, ``defaults`` where the text is null
    or '', and ``now`` fills those ``time_columns`` the target has.
    """
    added = rows
    for name, default in (defaults or {}).items():
        value = or_default(F.col(name), default) if name in rows.columns else F.lit(default)
        added = added.withColumn(name, value)
    for name, value in (constants or {}).items():
        added = added.withColumn(name, F.lit(value))
    if now is not None:
        for name in time_columns:
            if name in target.columns:
                added = added.withColumn(name, F.lit(now))
    unknown = sorted(set(added.columns) - set(target.columns))
    if unknown:
        raise ValueError(f"rows have columns the target lacks: {unknown}")
    added = added.select(
        *[
            (F.col(f.name) if f.name in added.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in target.schema.fields
        ]
    )
    return Change(target.unionByName(added), added)


def assign_keys(
    rows: DataFrame, key: str, start: int, order_by: Sequence[Term] | None = None
) -> DataFrame:
    """Generated keys above ``start``.

    With ``order_by`` (a unique order) keys are consecutive in that order;
    without, they are unique but have gaps, and no shuffle takes place.
    """
    if order_by is None:
        return rows.withColumn(key, F.monotonically_increasing_id() + F.lit(start + 1))
    numbered = number_rows(rows, order_columns(order_by), "_nth", unique=True)
    return numbered.withColumn(key, F.col("_nth") + F.lit(start + 1)).drop("_nth")


def next_key(target: DataFrame, key: str) -> int:
    """The largest key of ``target``, 0 if it is empty."""
    return int(target.agg(F.max(key).alias("top")).first()["top"] or 0)


def upsert(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    order_by: Sequence[Term],
    small: int = BROADCAST_BYTES,
) -> Change:
    """Merge ``staged`` into ``target`` by ``keys``, which are unique in ``target``.

    A repeated key in ``target`` is an error where the batch has it. Duplicates in ``staged`` fall to the first by ``order_by``. New keys are
    inserted whole; for known keys the ``update_cols`` take the staged value,
    null included, and other columns stay. A null key is an error.

    A batch that measures at most ``small`` bytes is broadcast, so the target is
    not shuffled; a larger one takes one full outer join.
    """
    unknown = sorted(set(update_cols) - set(target.columns))
    if unknown:
        raise ValueError(f"update columns not in target: {unknown}")
    columns = target.columns
    checked = staged.withColumns({k: _required_key(k) for k in keys})
    fresh = dedupe_by_key(checked, keys, order_by).select(*columns)
    batch = fresh.select(
        *keys,
        *[F.col(c).alias(f"_new_{c}") for c in columns if c not in keys],
        F.lit(True).alias("_staged"),
    )
    if is_small(staged.select(*columns), small):
        batch = F.broadcast(batch)
        found = target.join(batch.select(*keys), keys, "left_semi").groupBy(*keys).count()
        known = F.broadcast(found.filter(_once(keys)).select(*keys))
        updated = _merged(target.join(batch, keys, "left"), columns, keys, update_cols, None)
        inserted = fresh.join(known, keys, "left_anti").withColumn("_staged", F.lit(True))
        merged = updated.unionByName(inserted)
    else:
        joined = target.withColumn("_known", F.lit(True)).join(batch, keys, "full_outer")
        merged = _merged(joined, columns, keys, update_cols, F.col("_known").isNull())
    return Change(
        merged.drop("_staged"), merged.filter(F.col("_staged").isNotNull()).drop("_staged")
    )


def update_by_key(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    cols: Sequence[str],
    touch: Mapping[str, object] | None = None,
    skip_empty: bool = True,
    order_by: str | None = None,
) -> Change:
    """Set ``cols`` from ``changes``; null and '' leave a value alone if ``skip_empty``.

    ``touch`` columns (such as ``updated_at``) are set on every row with a given
    change. Several changes of one key apply in the order of ``order_by`` (ties in
    any order), so the last given value of each column wins. The status of a change is
    ``updated``, ``unchanged`` or ``not_found``.
    """
    given = {c: is_given(F.col(c)) if skip_empty else F.lit(True) for c in cols}
    changes = stage(changes, "changes")
    last = _last_given(changes, key, given, order_by)
    hint = hint_by_size(changes.select(key, *cols))
    joined = target.join(hint(last), key, "left")
    touched = F.lit(False)
    for c in cols:
        touched = touched | F.col(f"_new_{c}").isNotNull()
    values = {c: F.col(c) for c in target.columns}
    for c in cols:
        new = F.col(f"_new_{c}")
        values[c] = F.when(new.isNotNull(), new["value"].cast(target.schema[c].dataType)).otherwise(
            F.col(c)
        )
    for c, value in (touch or {}).items():
        stamp = F.lit(value).cast(target.schema[c].dataType)
        values[c] = F.when(touched, stamp).otherwise(F.col(c))
    updated = joined.select(
        *[values[c].alias(c) for c in target.columns], touched.alias("_touched")
    )
    any_given = F.lit(False)
    for condition in given.values():
        any_given = any_given | condition
    known = _found(target, last, [key], hint)
    status = (
        changes.join(known, key, "left")
        .withColumn(
            "status",
            F.when(F.col("_known").isNull(), "not_found")
            .when(any_given, "updated")
            .otherwise("unchanged"),
        )
        .drop("_known")
    )
    return Change(
        updated.drop("_touched"), updated.filter("_touched").drop("_touched"), status
    )


def update_all(target: DataFrame, values: Mapping[str, object]) -> Change:
    """Set columns of every row."""
    after = target.withColumns(
        {c: F.lit(v).cast(target.schema[c].dataType) for c, v in values.items()}
    )
    return Change(after, after)


def insert_unique(
    target: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    order_by: str,
) -> Change:
    """Insert rows whose ``keys`` are new; the first by ``order_by`` (unique) wins.

    ``status`` holds every input row with ``reason`` null if it was accepted,
    else ``missing``, ``known`` or ``repeated``.
    """
    first = rows.groupBy(*keys).agg(F.min(order_by).alias("_first"))
    hint = hint_by_size(rows.select(*keys))
    checks = first.join(_found(target, first, keys, hint).distinct(), list(keys), "left")
    missing = F.lit(False)
    for k in keys:
        missing = missing | ~is_given(F.col(k))
    judged = (
        rows.join(hint(checks), list(keys), "left")
        .withColumn(
            "reason",
            F.when(missing, "missing")
            .when(F.col("_known"), "known")
            .when(F.col(order_by) != F.col("_first"), "repeated"),
        )
        .drop("_first", "_known")
    )
    status = stage(judged, "judged")  # read for the status and for what is accepted
    accepted = status.filter(F.col("reason").isNull()).drop("reason")
    kept = [c for c in target.columns if c in accepted.columns]
    return Change(
        target.unionByName(accepted.select(*kept), allowMissingColumns=True), accepted, status
    )


def _found(
    target: DataFrame,
    wanted: DataFrame,
    keys: Sequence[str],
    hint: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The ``wanted`` keys that ``target`` has, marked ``_known``."""
    reduced = target.select(*keys).join(hint(wanted.select(*keys)), list(keys), "left_semi")
    return reduced.withColumn("_known", F.lit(True))


def _merged(
    joined: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    update_cols: Sequence[str],
    is_new: Column | None,
) -> DataFrame:
    """Target columns of a join of the target with a staged batch."""
    values = []
    for c in columns:
        if c in keys:
            values.append(F.col(c))
            continue
        staged = F.col("_staged").isNotNull() if c in update_cols else F.lit(False)
        if is_new is not None:
            staged = staged | is_new
        values.append(F.when(staged, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*values, "_staged")


def _once(keys: Sequence[str]) -> Column:
    """True for a key that is counted once; an error for others."""
    twice = F.raise_error(F.concat_ws(" ", F.lit("repeated key in the table:"), *[F.col(k).cast("string") for k in keys]))
    return F.when(F.col("count") == 1, F.lit(True)).otherwise(twice.cast("boolean"))


def _required_key(key: str) -> Column:
    column = F.col(key)
    return F.when(column.isNull(), F.raise_error(F.lit(f"null key: {key}"))).otherwise(column)


def _last_given(
    changes: DataFrame, key: str, given: Mapping[str, Column], order_by: str | None
) -> DataFrame:
    """One row per key with the last given value of each column as ``_new_<column>``.

    A value is wrapped in a struct, so that a given null differs from none. The
    last change of a column is found by numbers alone, which are combined by hash
    before the shuffle, and its value is joined to it.
    """
    row = F.monotonically_increasing_id().alias("_row")  # of a written table, so it is fixed
    numbered = changes.select(key, *given, *([order_by] if order_by else []), row)
    if order_by:
        tops = numbered.groupBy(key).agg(
            *[F.max(F.when(g, F.col(order_by))).alias(f"_top_{c}") for c, g in given.items()]
        )
        placed = numbered.join(tops, key)
        last = {c: g & F.col(order_by).eqNullSafe(F.col(f"_top_{c}")) for c, g in given.items()}
    else:
        placed, last = numbered, given
    rows = placed.groupBy(key).agg(
        *[F.max(F.when(is_last, F.col("_row"))).alias(f"_at_{c}") for c, is_last in last.items()]
    )
    for c in given:
        values = numbered.select(F.col("_row").alias(f"_at_{c}"), F.struct(F.col(c).alias("value")).alias(f"_new_{c}"))
        rows = rows.join(values, f"_at_{c}", "left")
    return rows.select(key, *[f"_new_{c}" for c in given])


def _reversed(term: Term) -> Term:
    value, direction = term if isinstance(term, tuple) else (term, "asc")
    return value, "desc" if direction == "asc" else "asc"
