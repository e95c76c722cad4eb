"""Users, permission codes and the links between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.change import Change
from rollbook.plans import hint_by_size, rank_in_group, stage

# Codes that one row may hold; a catalogue with more of them is refused.
MOST_CODES = 1_000_000


def permission_codes(
    links: DataFrame,
    permissions: DataFrame,
    user_ids: Sequence[object] | None = None,
    user: str = "user_id",
    permission: str = "permission_id",
    permission_key: str = "id",
    code: str = "code",
) -> DataFrame:
    """One row per link with its code, for some users or all."""
    chosen = links if user_ids is None else links.filter(F.col(user).isin(list(user_ids)))
    codes = permissions.select(F.col(permission_key).alias(permission), F.col(code).alias("code"))
    return chosen.join(codes, permission).select(user, "code")


def codes_per_user(
    users: DataFrame,
    links: DataFrame,
    permissions: DataFrame,
    user_ids: Sequence[object] | None = None,
    user_key: str = "id",
    user: str = "user_id",
    permission: str = "permission_id",
    permission_key: str = "id",
    code: str = "code",
) -> DataFrame:
    """Every user, or those in ``user_ids``, with the sorted array of their codes.

    One row per user; the array is empty if there are no codes, and null codes
    are left out. A user holds a permission once however often it is linked, so
    an array has at most the rows of ``permissions``; more than ``MOST_CODES``
    is an error, for which ``codes_in_rows`` is the way out.
    """
    if user_ids is not None:
        users = users.filter(F.col(user_key).isin(list(user_ids)))
    held = _held_codes(links, permissions, user_ids, user, permission, permission_key, code)
    arrays = held.groupBy(user).agg(F.sort_array(F.collect_list("code")).alias("codes"))
    arrays = arrays.withColumnRenamed(user, "_holder")
    many = F.raise_error(F.lit(f"a user has more than {MOST_CODES} codes"))
    codes = F.when(F.size("codes") > MOST_CODES, many.cast("array<string>")).otherwise(
        F.coalesce("codes", F.array().cast("array<string>"))
    )
    return users.join(arrays, F.col(user_key) == F.col("_holder"), "left").select(
        *users.columns, codes.alias("codes")
    )


def codes_of_requested(
    users: DataFrame,
    links: DataFrame,
    permissions: DataFrame,
    requests: DataFrame,
    request: str = "request_id",
    user_key: str = "id",
    user: str = "user_id",
) -> tuple[DataFrame, DataFrame]:
    """The requested users with their codes, and each request with its status.

    ``requests`` has ``request`` and ``user_key``; the status is ``found`` or
    ``not_found``. Only the links of users asked for are joined.
    """
    hint = hint_by_size(requests.select(user_key))
    asked = hint(requests.select(user_key).distinct())
    chosen = users.join(asked, user_key, "left_semi").select(*users.columns)
    theirs = links.join(asked.withColumnRenamed(user_key, user), user, "left_semi")
    known = hint(chosen.select(user_key, F.lit(True).alias("_known")))
    status = requests.join(known, user_key, "left").select(
        *requests.columns, F.when(F.col("_known"), "found").otherwise("not_found").alias("status")
    )
    return codes_per_user(chosen, theirs, permissions, user_key=user_key, user=user), status


def codes_in_rows(
    links: DataFrame,
    permissions: DataFrame,
    user: str = "user_id",
    permission: str = "permission_id",
    permission_key: str = "id",
    code: str = "code",
) -> DataFrame:
    """``user, code, position`` with positions from 1 in the order of a user's codes.

    For catalogues of any size: a user's rows may span many tasks.
    """
    held = _held_codes(links, permissions, None, user, permission, permission_key, code)
    return rank_in_group(held, [user], [F.col("code").asc()], "position")


def _held_codes(
    links: DataFrame,
    permissions: DataFrame,
    user_ids: Sequence[object] | None,
    user: str,
    permission: str,
    permission_key: str,
    code: str,
) -> DataFrame:
    """user and code of each permission held that has a code, once however often it is linked."""
    once = links.select(user, permission).distinct()
    held = permission_codes(once, permissions, user_ids, user, permission, permission_key, code)
    return held.filter(F.col("code").isNotNull())


def has_access(
    users: DataFrame,
    links: DataFrame,
    user_key: str = "id",
    role: str = "role",
    user: str = "user_id",
    admin: str = "admin",
) -> DataFrame:
    """Every user with ``allowed``: an admin, or linked to any permission."""
    linked = links.select(F.col(user).alias("_linked")).distinct()
    allowed = (F.coalesce(F.col(role), F.lit("")) == admin) | F.col("_linked").isNotNull()
    return (
        users.join(linked, F.col(user_key) == F.col("_linked"), "left")
        .withColumn("allowed", allowed)
        .drop("_linked")
    )


def replace_set(
    links: DataFrame,
    requests: DataFrame,
    users: DataFrame,
    order_by: str,
    user: str = "user_id",
    permission: str = "permission_id",
    ids: str = "ids",
    user_key: str = "id",
) -> Change:
    """Replace the permission set of every requested user.

    A null list leaves the links alone, an empty one removes them. A list with
    a repeated id is rejected whole. Of several lists for a user the last by
    ``order_by``, which is unique for a user, stays. Status: ``applied``, ``untouched``, ``rejected`` or
    ``not_found``.
    """
    requests = stage(requests, "requests")
    hint = hint_by_size(requests.select(user, ids))
    known = _known_users(users, user_key, requests, user, hint)
    repeated = F.size(F.array_distinct(ids)) < F.size(ids)
    status = (
        requests.join(known, user, "left")
        .withColumn(
            "status",
            F.when(F.col("_known").isNull(), "not_found")
            .when(F.col(ids).isNull(), "untouched")
            .when(repeated, "rejected")
            .otherwise("applied"),
        )
        .drop("_known")
    )
    # Of the requests of a user only the last is left before the join.
    usable = requests.filter(F.col(ids).isNotNull() & ~repeated)
    last = usable.groupBy(user).agg(F.max(order_by).alias(order_by))
    final = usable.join(last, [user, order_by]).select(user, ids)
    final = final.join(known, user, "left_semi")
    kept = links.join(hint(final.select(user)), user, "left_anti").select(*links.columns)
    added = final.select(user, F.explode(ids).alias(permission))
    added = added.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in links.schema.fields]
    )
    return Change(kept.unionByName(added), added, status)


def assign_codes(
    users: DataFrame,
    requests: DataFrame,
    permissions: DataFrame,
    user: str = "user_id",
    codes: str = "codes",
    user_key: str = "id",
    permission_key: str = "id",
    code: str = "code",
) -> tuple[DataFrame, DataFrame]:
    """New links for the codes asked for, and the status of each request.

    Unknown codes are dropped and repeated ones count once; a request for an
    unknown user gives no links and the status ``not_found``.
    """
    requests = stage(requests, "requests")
    hint = hint_by_size(requests.select(user, codes))
    known = _known_users(users, user_key, requests, user, hint)
    status = (
        requests.join(known, user, "left")
        .withColumn("status", F.when(F.col("_known"), "assigned").otherwise("not_found"))
        .drop("_known")
    )
    asked = requests.select(user, F.explode(codes).alias("code")).distinct()
    asked = asked.join(known, user, "left_semi")
    ids = permissions.select(
        F.col(permission_key).alias("permission_id"), F.col(code).alias("code")
    )
    links = asked.join(ids, "code").select(user, "permission_id").distinct()
    return links, status


def _known_users(
    users: DataFrame,
    user_key: str,
    requests: DataFrame,
    user: str,
    hint: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The requested users that exist, marked ``_known``."""
    asked = hint(requests.select(user).distinct())
    found = users.select(F.col(user_key).alias(user)).join(asked, user, "left_semi")
    return hint(found.withColumn("_known", F.lit(True)))
