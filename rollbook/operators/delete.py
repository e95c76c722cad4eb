"""Deletes as pure functions: by key, by owner, by group, with references.

Requests carry a unique ``request_id``; they count in that order, so a row can
be deleted by one request only and later ones find it gone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook import plans
from rollbook.operators.change import Change
from rollbook.plans import stage

REQUEST = "request_id"

# Sides with a hint have unique keys, no more than are asked for.
hint_by_size = partial(plans.hint_by_size, hashed=True)


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``child.fk`` holds values of ``parent.key``."""

    child: str
    fk: str
    parent: str
    key: str


@dataclass(frozen=True)
class Truncation:
    """Tables after a truncate, its status and the next generated id per table."""

    status: str
    tables: dict[str, DataFrame]
    next_ids: dict[str, int]


def delete_by_key(target: DataFrame, requests: DataFrame, keys: Sequence[str]) -> Change:
    """Rows whose key is requested; ``affected`` holds them.

    Requests with a ``request_id`` get a status: ``deleted`` for the first
    request of a key that has rows, ``not_found`` for others.
    """
    hint = hint_by_size(requests.select(*keys))
    change = _split_by(target, hint(requests.select(*keys).distinct()), keys)
    if REQUEST not in requests.columns:
        return change
    first = requests.groupBy(*keys).agg(F.min(REQUEST).alias(REQUEST))
    done = target.select(*keys).join(hint(first), list(keys)).select(REQUEST).distinct()
    status = _with_status(requests, done, hint, "not_found")
    return Change(change.after, change.affected, status)


def delete_scoped(
    target: DataFrame,
    requests: DataFrame,
    key: str,
    owner: str,
    owners: DataFrame | None = None,
    owner_link: tuple[str, str] | None = None,
    admin: str = "admin",
) -> Change:
    """Delete requested rows that the requester may delete.

    ``requests`` has request_id, ``key``, user_id and role. An admin may delete
    any row, others only their own: ``owner`` is a column of ``target``, or of
    ``owners``, which ``target`` reaches by ``owner_link`` = (target column,
    owners column). Status: ``deleted`` or ``refused``.
    """
    hint = hint_by_size(requests.select(key, "user_id", "role"))
    found = target.join(hint(requests.select(key).distinct()), key, "left_semi")
    held = hint(_owned_keys(found, key, owner, owners, owner_link, hint))
    first = _first_allowed(requests, held, key, admin, hint).join(held, key, "left_semi")
    status = _with_status(requests, first, hint, "refused")
    change = _split_by(target, hint(first.select(key)), [key])
    return Change(change.after, change.affected, status)


def delete_group(
    target: DataFrame,
    requests: DataFrame,
    parents: DataFrame,
    fk: str,
    parent_key: str,
    owner: str,
    admin: str = "admin",
) -> Change:
    """Delete all rows of a parent on request.

    ``requests`` has request_id, ``fk``, user_id and role. Admins may empty any
    group, others that of a parent they own. Status: ``deleted`` with the
    number of rows, ``already_empty`` or ``refused``.
    """
    hint = hint_by_size(requests.select(fk, "user_id", "role"))
    held = parents.select(F.col(parent_key).alias(fk), F.col(owner).alias("_owner"))
    held = hint(held.join(hint(requests.select(fk).distinct()), fk, "left_semi"))
    first = _first_allowed(requests, held, fk, admin, hint)
    # Rows are counted ahead of the join if that shuffles.
    if hint is F.broadcast:
        counted = _counts(target.join(hint(first.select(fk)), fk, "left_semi"), fk)
    else:
        counted = _counts(target, fk)
    done = counted.join(hint(first), fk).select(REQUEST, F.col("_rows"))

    own = held.select(fk, F.col("_owner").alias("user_id"), F.lit(True).alias("_own"))
    may = (F.coalesce(F.col("role"), F.lit("")) == admin) | F.col("_own").isNotNull()
    status = (
        requests.join(hint(own), [fk, "user_id"], "left")
        .join(hint(done), REQUEST, "left")
        .withColumn(
            "status",
            F.when(F.col("_rows").isNotNull(), "deleted")
            .when(may, "already_empty")
            .otherwise("refused"),
        )
        .withColumn("rows", F.coalesce(F.col("_rows"), F.lit(0)))
        .select(*requests.columns, "status", "rows")
    )
    change = _split_by(target, hint(first.select(fk)), [fk])
    return Change(change.after, change.affected, status)


def delete_restricted(
    target: DataFrame,
    requests: DataFrame,
    key: str,
    child: DataFrame,
    fk: str,
) -> Change:
    """Delete rows by key unless a child row refers to them.

    Status: ``refused`` (in use), ``deleted`` or ``not_found``.
    """
    hint = hint_by_size(requests.select(key))
    used = child.select(F.col(fk).alias(key))
    if hint is F.broadcast:
        judged = _judged_by_joins(requests, target.select(key), used, key)
    else:
        judged = _judged_in_shares(requests, target.select(key), used, key)
    status = (
        requests.join(hint(judged), key, "left")
        .withColumn(
            "status",
            F.when(F.col("_known").isNull(), "not_found")
            .when(F.col("_used"), "refused")
            .when(F.col(REQUEST) == F.col("_first"), "deleted")
            .otherwise("not_found"),
        )
        .select(*requests.columns, "status")
    )
    gone = judged.filter(F.col("_known") & F.col("_used").isNull()).select(key)
    change = _split_by(target, hint(gone), [key])
    return Change(change.after, change.affected, status)


def _judged_by_joins(requests: DataFrame, known: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """key, _first, _known and _used of each key asked for; the keys are broadcast, no table is shuffled."""
    first = requests.groupBy(key).agg(F.min(REQUEST).alias("_first"))
    asked = F.broadcast(first.select(key))
    known = known.join(asked, key, "left_semi").withColumn("_known", F.lit(True))
    used = used.join(asked, key, "left_semi").distinct().withColumn("_used", F.lit(True))
    return first.join(F.broadcast(known), key, "left").join(F.broadcast(used), key, "left")


def _judged_in_shares(requests: DataFrame, known: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """The rows of ``_judged_by_joins`` by one aggregate of all keys, which can spill.

    Keys are dealt into shares by their size, so neither the aggregate nor a join with its rows
    takes more memory in a task as tables grow.
    """
    parts = plans.parts_by_size(requests.select(key), known, used)
    marks = requests.select(key, F.col(REQUEST).alias("_first"))
    for mark, rows in (("_known", known), ("_used", used.distinct())):
        marks = marks.unionByName(rows.withColumn(mark, F.lit(True)), allowMissingColumns=True)
    judged = marks.repartition(parts, key).groupBy(key).agg(
        F.min("_first").alias("_first"), F.max("_known").alias("_known"), F.max("_used").alias("_used")
    )
    return judged.filter(F.col("_first").isNotNull())


def delete_cascade(
    tables: Mapping[str, DataFrame],
    references: Sequence[Reference],
    name: str,
    requests: DataFrame,
    keys: Sequence[str],
) -> dict[str, Change]:
    """Delete rows of ``name`` and, through ``references``, all rows below them.

    The change of ``name`` has the status of each request, as ``delete_by_key``
    gives it. What is taken along on each level is written once, since the
    levels below and both sides of a change read it. References may form cycles, and a
    table may refer to itself: then rounds follow them until no further row is found.
    """
    if _is_cyclic(references, name):
        return _cascade_in_rounds(tables, references, name, requests, keys)
    changes = {name: delete_by_key(tables[name], requests, keys)}
    for table in _below(references, name):
        after, affected = tables[table], None
        for ref in references:
            if ref.child != table or ref.parent not in changes:
                continue
            gone = _gone_keys(changes[ref.parent].affected, ref)
            step = delete_by_key(after, gone, [ref.fk])
            after = step.after
            affected = (
                step.affected if affected is None else affected.unionByName(step.affected)
            )
        changes[table] = Change(after, affected)
    return changes


def _cascade_in_rounds(
    tables: Mapping[str, DataFrame],
    references: Sequence[Reference],
    name: str,
    requests: DataFrame,
    keys: Sequence[str],
) -> dict[str, Change]:
    """``delete_cascade`` along cycles: each round looks below the rows that the last one has found.

    A round joins a table only with keys that are new, and drops rows that were found before, which
    their own references tell; so it ends when nothing is added. Only keys are written, and Spark
    broadcasts written keys by their size.
    """
    below = {name, *_reached(references, name)}
    used = [r for r in references if r.parent in below]
    needed = {t: list(dict.fromkeys([r.key for r in used if r.parent == t])) for t in below}
    first = delete_by_key(tables[name], requests, keys)
    asked = stage(requests.select(*keys).distinct(), "asked")
    # What makes a row of each table go: values of one or more of its columns.
    reasons: dict[str, dict[tuple[str, ...], DataFrame]] = {t: {} for t in below}
    reasons[name][tuple(keys)] = asked
    fresh = {name: stage(first.affected.select(*needed[name]).distinct(), "found")} if needed[name] else {}
    while fresh:
        found: dict[str, DataFrame] = {}
        for ref in used:
            if ref.parent not in fresh:
                continue
            why, known = (ref.fk,), reasons[ref.child].get((ref.fk,))
            gone = fresh[ref.parent].select(F.col(ref.key).alias(ref.fk)).filter(F.col(ref.fk).isNotNull()).distinct()
            gone = stage(gone if known is None else gone.join(known, ref.fk, "left_anti"), "gone")
            if gone.isEmpty():
                continue
            rows = tables[ref.child].join(gone, ref.fk, "left_semi")
            for columns, earlier in reasons[ref.child].items():
                rows = rows.join(earlier, list(columns), "left_anti")
            reasons[ref.child][why] = gone if known is None else stage(known.unionByName(gone), "gone")
            if needed[ref.child]:
                step = stage(rows.select(*needed[ref.child]).distinct(), "found")
                found[ref.child] = step if ref.child not in found else found[ref.child].unionByName(step)
        fresh = {t: df for t, df in found.items() if not df.isEmpty()}
    return {t: _split_by_any(tables[t], reasons[t], first.status if t == name else None) for t in sorted(below)}


def _split_by_any(target: DataFrame, reasons: Mapping[tuple[str, ...], DataFrame], status: DataFrame | None) -> Change:
    """Rows of ``target`` that no reason names, and the others."""
    marked, hit = target, F.lit(False)
    for number, (columns, values) in enumerate(reasons.items()):
        mark = f"_hit_{number}"
        marked = marked.join(values.withColumn(mark, F.lit(True)), list(columns), "left")
        hit = hit | F.col(mark).isNotNull()
    return Change(
        marked.filter(~hit).select(*target.columns), marked.filter(hit).select(*target.columns), status
    )


def _gone_keys(affected: DataFrame, ref: Reference) -> DataFrame:
    keys = affected.select(F.col(ref.key).alias(ref.fk)).distinct()
    return stage(keys, "gone")


def truncate(
    tables: Mapping[str, DataFrame],
    name: str,
    references: Sequence[Reference] = (),
    refuse_empty: bool = False,
) -> Truncation:
    """Empty ``name`` and every table that refers to it, and restart their ids.

    ``refuse_empty`` leaves all tables alone if ``name`` holds no rows; the
    status is then ``already_empty``.
    """
    if refuse_empty and tables[name].isEmpty():
        return Truncation("already_empty", dict(tables), {})
    emptied = {name, *_reached(references, name)}
    after = {t: df.limit(0) if t in emptied else df for t, df in tables.items()}
    return Truncation("deleted", after, dict.fromkeys(sorted(emptied), 1))


def _first_allowed(
    requests: DataFrame,
    held: DataFrame,
    key: str,
    admin: str,
    hint: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """key and the first request of it by an admin or by the owner in ``held``.

    Repeated requests are combined before the join, and the join is by key and
    user, so a key that very many ask for is spread by its users.
    """
    by_admin = requests.filter(F.col("role") == admin).select(key, REQUEST)
    asked = requests.groupBy(key, "user_id").agg(F.min(REQUEST).alias(REQUEST))
    owners = held.select(key, F.col("_owner").alias("user_id"))
    by_owner = asked.join(hint(owners), [key, "user_id"]).select(key, REQUEST)
    return by_admin.unionByName(by_owner).groupBy(key).agg(F.min(REQUEST).alias(REQUEST))


def _with_status(
    requests: DataFrame, done: DataFrame, hint: Callable[[DataFrame], DataFrame], other: str
) -> DataFrame:
    """``requests`` with status ``deleted`` for those in ``done``."""
    marked = done.select(REQUEST, F.lit("deleted").alias("_done"))
    return requests.join(hint(marked), REQUEST, "left").select(
        *requests.columns, F.coalesce("_done", F.lit(other)).alias("status")
    )


def _counts(rows: DataFrame, fk: str) -> DataFrame:
    return rows.groupBy(fk).agg(F.count(F.lit(1)).alias("_rows"))


def _split_by(target: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> Change:
    """Rows of ``target`` without and with a wanted key; wanted keys are distinct."""
    return Change(
        target.join(wanted, list(keys), "left_anti").select(*target.columns),
        target.join(wanted, list(keys), "left_semi").select(*target.columns),
    )


def _owned_keys(
    found: DataFrame,
    key: str,
    owner: str,
    owners: DataFrame | None,
    owner_link: tuple[str, str] | None,
    hint: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """key, _found and _owner of the ``found`` rows, which are as few as the requests."""
    marker = F.lit(True).alias("_found")
    if owners is None:
        return found.select(F.col(key), F.col(owner).alias("_owner"), marker)
    link, owners_key = owner_link
    linked = found.select(F.col(key), F.col(link).alias("_link"), marker)
    held = owners.select(F.col(owners_key).alias("_link"), F.col(owner).alias("_owner"))
    held = held.join(hint(linked.select("_link").distinct()), "_link", "left_semi")
    return linked.join(hint(held), "_link", "left").drop("_link")


def _reached(references: Sequence[Reference], name: str) -> set[str]:
    """Tables with references to ``name`` or to one of them, ``name`` itself only through a cycle."""
    found: set[str] = set()
    while more := {r.child for r in references if r.parent in {name, *found}} - found:
        found |= more
    return found


def _is_cyclic(references: Sequence[Reference], name: str) -> bool:
    tables = {name, *_reached(references, name)}
    return any(t in _reached(references, t) for t in tables)


def _below(references: Sequence[Reference], name: str) -> list[str]:
    """Tables reached from ``name`` without a cycle, each after all of its affected parents."""
    order: list[str] = []

    def visit(table: str) -> None:
        if table in order:
            return
        for ref in references:
            if ref.parent == table:
                visit(ref.child)
        order.append(table)

    visit(name)
    return [t for t in reversed(order) if t != name]
