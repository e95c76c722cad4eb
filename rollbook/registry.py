"""The registry's own queries and loads, bound to its tables.

Each function is one request of the registry in set form. Changes give
``Change`` frames; nothing is written until ``sources.store.publish`` or ``merge``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook import tables
from rollbook.functions.predicates import matches, search
from rollbook.functions.text import blank_nulls, is_given, or_default, trim_all
from rollbook.functions.typed import (
    exact_int,
    leading_int,
    leading_int_of,
    mixed_date,
    strict_int,
)
from rollbook.operators import access, change, delete, listing, split, stats, validate
from rollbook.operators.change import Change
from rollbook.operators.children import children_page, children_pages
from rollbook.operators.listing import Lookup, Page
from rollbook.operators.rename import rename_unique
from rollbook.plans import stage
from rollbook.sources import csv, store, workbook

SOURCE_ORDER = "source_order"

# --- loads ---------------------------------------------------------------


def load_schools(
    spark: SparkSession, path: str, schools: DataFrame, schema: T.StructType | None = None
) -> Change:
    """Merge a CSV or workbook of schools by ``sekolah_id``."""
    return _load_upsert(spark, path, schools, tables.SCHOOLS, schema, "a")


def load_staff(
    spark: SparkSession, path: str, staff: DataFrame, schema: T.StructType | None = None
) -> Change:
    """Merge a CSV or workbook of staff by ``ptk_id``."""
    return _load_upsert(spark, path, staff, tables.STAFF, schema, "a")


def load_candidates(
    spark: SparkSession, path: str, candidates: DataFrame, schema: T.StructType | None = None
) -> Change:
    """Merge a CSV or workbook of candidates by (``no_ukg``, ``tahun``)."""
    return _load_upsert(spark, path, candidates, tables.CANDIDATES, schema, "d")


def merge_file(
    spark: SparkSession,
    path: str,
    table_dir: str,
    table: tables.UpsertTable,
    schema: T.StructType | None = None,
    rule: str = "a",
) -> None:
    """Load a file and merge it into a table by key range, all of it or nothing.

    ``table`` is ``tables.SCHOOLS``, ``STAFF`` or ``CANDIDATES``.
    """
    staged = _staged_file(spark, path, schema or table.schema, rule)
    store.merge(staged, table_dir, table.key, table.updates, [SOURCE_ORDER])


def load_participants(
    spark: SparkSession,
    path: str,
    participants: DataFrame,
    kegiatan_id: int,
    on_unknown: str = "fail",
) -> Change:
    """Append a CSV or workbook of participants, bound by column name, to an activity.

    New rows get the next ids in source order.
    """
    if not kegiatan_id:
        raise ValueError("kegiatan_id is required")
    allowed = tables.PARTICIPANT_COLUMNS
    if _is_workbook(path):
        rows = workbook.workbook_rows(spark, path, "c")
        staged = workbook.rows_by_name(rows, allowed, on_unknown=on_unknown)
    else:
        staged = csv.load_mixed_by_name(spark, path, allowed, on_unknown, source_order=SOURCE_ORDER)
    trimmed = trim_all(staged.select(*allowed, SOURCE_ORDER), allowed)
    keyed = _in_source_order(trimmed, "peserta_id", participants)
    return change.append(participants, keyed, constants={"kegiatan_id": kegiatan_id})


def load_activities(
    spark: SparkSession,
    path: str,
    activities: DataFrame,
    users_id: int,
    now: object,
    min_serial: int = 0,
    strict: bool = True,
) -> Change:
    """Append a CSV or workbook of activities, with dates and integers parsed from text.

    New rows get the next ids in source order.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in tables.ACTIVITY_STAGED])
    staged = _staged_file(spark, path, schema, "b")
    texts = ["nama_kegiatan", "penanggung_jawab", "tempat_pelaksanaan"]
    dates = ["tanggal_mulai", "tanggal_selesai"]
    numbers = ["team_id", "tahun", "sasaran_peserta", "total_peserta"]
    typed = trim_all(staged, texts).withColumns(
        {
            **{c: mixed_date(F.col(c), min_serial, strict) for c in dates},
            **{c: strict_int(F.col(c), strict) for c in numbers},
        }
    )
    keyed = _in_source_order(typed, "id", activities)
    return change.append(activities, keyed, constants={"users_id": users_id}, now=now)


def split_csv(
    spark: SparkSession,
    path: str,
    out: str,
    base: str,
    rows_per_part: int = split.ROWS_PER_PART,
    one_task_bytes: int | None = None,
) -> DataFrame:
    """Split a CSV file in source order into files with its header.

    Gives the manifest: part, name, number of rows and the file that holds it.
    """
    parts = csv_parts(spark, path, rows_per_part, one_task_bytes)
    split.write_parts(parts, out, base)
    return split.part_manifest(parts, base).join(split.part_files(spark, out), "name")


def csv_parts(
    spark: SparkSession,
    path: str,
    rows_per_part: int = split.ROWS_PER_PART,
    one_task_bytes: int | None = None,
) -> DataFrame:
    """The rows of a CSV file with their part and row in it, counted in source order."""
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    order = "_source_order"
    loaded = csv.load_positional(
        spark, path, schema, source_order=order, one_task_bytes=one_task_bytes
    )
    return split.split_parts(loaded, [order], rows_per_part, unique=True).drop(order)


# --- schools and staff ---------------------------------------------------


def list_schools(schools: DataFrame, page: object = None, limit: object = None) -> Page:
    return listing.page(schools, ["sekolah_id"], "sekolah_id", page, limit)


def search_schools(
    schools: DataFrame, q: str = "", page: object = None, limit: object = None
) -> Page:
    found = search(schools, [("sekolah_id", "exact"), ("nama", "contains")], q)
    return listing.page(found, ["nama"], "sekolah_id", page, limit)


def school_with_staff(
    schools: DataFrame,
    staff: DataFrame,
    sekolah_id: str,
    q: str = "",
    page: object = None,
    limit: object = None,
) -> DataFrame:
    """One school with a page of its staff; no row if it is unknown."""
    row = children_page(
        schools, staff, sekolah_id, page_no=page, limit=limit, **_school_staff(q)
    )
    return _school_names(row)


def schools_with_staff(
    schools: DataFrame,
    staff: DataFrame,
    q: str = "",
    page: object = None,
    limit: object = None,
) -> DataFrame:
    """Every school with the same page of its staff."""
    return _school_names(
        children_pages(schools, staff, page_no=page, limit=limit, **_school_staff(q))
    )


def list_staff(staff: DataFrame, page: object = None, limit: object = None) -> Page:
    return listing.page(staff, ["ptk_id"], "ptk_id", page, limit)


def search_staff(
    staff: DataFrame, q: str = "", page: object = None, limit: object = None
) -> Page:
    terms = [("ptk_id", "exact"), ("nama", "contains"), ("nip", "contains")]
    return listing.page(search(staff, terms, q), ["nama"], "ptk_id", page, limit)


def staff_statistics(staff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statistics columns of all staff, and the total."""
    return stats.feed(staff, tables.STAFF_STATISTICS)


def staff_distribution(staff: DataFrame) -> DataFrame:
    """Counts and shares per value of the statistics columns."""
    return stats.distribution(staff, tables.STAFF_STATISTICS[2:])


# --- candidates ----------------------------------------------------------


def list_candidates(candidates: DataFrame, page: object = None, limit: object = None) -> Page:
    """Candidates by number, with blanks for nulls."""
    order = [(exact_int(F.col("no")), "asc")]
    cut = listing.page(candidates, order, tables.CANDIDATE_KEY, page, limit)
    return Page(cut.page, cut.limit, blank_nulls(cut.rows), cut.summary)


def search_candidates(
    candidates: DataFrame,
    keyword: str = "",
    query: str = "",
    page: object = None,
    limit: object = None,
) -> Page:
    found = search(candidates, [("nama_lengkap", "contains")], keyword or query, trim=True)
    return listing.page(found, ["nama_lengkap"], tables.CANDIDATE_KEY, page, limit)


# --- activities ----------------------------------------------------------


def list_activities(
    activities: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    page: object = None,
    limit: object = None,
    total: str = "base",
) -> Page:
    return _activity_page(activities, users, teams, page, limit, total)


def search_activities(
    activities: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    q: str = "",
    page: object = None,
    limit: object = None,
    total: str = "base",
) -> Page:
    found = activities.filter(matches([("nama_kegiatan", "contains")], q, trim=True))
    return _activity_page(found, users, teams, page, limit, total)


def activities_by_id(
    activities: DataFrame, users: DataFrame, teams: DataFrame, ids: Sequence[object]
) -> DataFrame:
    """Activities with their lookups; an id must start with an integer."""
    found = listing.by_key(activities, "id", [_number(i) for i in ids])
    return listing.with_lookups(found, _activity_lookups(users, teams)).select(
        *tables.ACTIVITY_LISTED
    )


def insert_activities(
    activities: DataFrame, rows: DataFrame, now: object, order_by: Sequence[str] | None = None
) -> tuple[Change, validate.Validation]:
    """Append activities with two numbers, of which the total is within the target."""
    counts = ("sasaran_peserta", "total_peserta")
    rules = [validate.not_greater("total_peserta", "sasaran_peserta")]
    judged = validate.validate_rows(rows, rules + [validate.is_int(c) for c in counts])
    numbers = {c: leading_int(F.col(c)) for c in counts}
    return _insert(activities, judged.good.withColumns(numbers), "id", now, order_by), judged


def delete_activities(activities: DataFrame, requests: DataFrame) -> Change:
    """Requests (request_id, id, user_id, role): admins any, others their own."""
    return delete.delete_scoped(activities, requests, "id", "users_id")


# --- participants --------------------------------------------------------


def list_participants(
    participants: DataFrame, page: object = None, limit: object = None
) -> Page:
    return listing.page(participants, ["peserta_id"], "peserta_id", page, limit)


def search_participants(
    participants: DataFrame, q: str = "", page: object = None, limit: object = None
) -> Page:
    found = search(participants, [("nama", "contains")], q)
    return listing.page(found, ["nama"], "peserta_id", page, limit)


def participants_by_id(participants: DataFrame, ids: Sequence[object]) -> DataFrame:
    return listing.by_key(participants, "peserta_id", ids)


def insert_participants(
    participants: DataFrame, rows: DataFrame, order_by: Sequence[str] | None = None
) -> tuple[Change, validate.Validation]:
    """Append participants with all required fields; the role has a default."""
    judged = validate.validate_rows(rows, validate.required(*tables.PARTICIPANT_REQUIRED))
    good = judged.good.withColumn("peran", or_default(F.col("peran"), tables.PARTICIPANT_ROLE))
    return _insert(participants, good, "peserta_id", None, order_by), judged


def delete_participants(
    participants: DataFrame, requests: DataFrame, activities: DataFrame
) -> Change:
    """Requests (request_id, peserta_id, user_id, role): by the activity's owner or an admin."""
    return delete.delete_scoped(
        participants,
        requests,
        "peserta_id",
        "users_id",
        owners=activities,
        owner_link=("kegiatan_id", "id"),
    )


def delete_activity_participants(
    participants: DataFrame, requests: DataFrame, activities: DataFrame
) -> Change:
    """Requests (request_id, kegiatan_id, user_id, role) to empty whole activities."""
    return delete.delete_group(
        participants, requests, activities, "kegiatan_id", "id", "users_id"
    )


# --- users ---------------------------------------------------------------


def list_users(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All users by id, and the total."""
    rows, total = stats.feed(users, tables.USER_LISTED)
    return rows.orderBy("id"), total


def users_with_codes(
    users: DataFrame,
    links: DataFrame,
    permissions: DataFrame,
    user_ids: Sequence[object] | None = None,
) -> DataFrame:
    """All users, or those with an id in ``user_ids``, with the permission codes they hold."""
    listed = users.select(*tables.USER_LISTED)
    return access.codes_per_user(listed, links, permissions, user_ids)


def users_by_id(
    users: DataFrame, links: DataFrame, permissions: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The users asked for with their codes, and the status of each request (request_id, id)."""
    listed = users.select(*tables.USER_LISTED)
    return access.codes_of_requested(listed, links, permissions, requests)


def create_users(
    users: DataFrame,
    links: DataFrame,
    permissions: DataFrame,
    requests: DataFrame,
    now: object,
    required: Sequence[str] = tables.USER_REQUIRED,
    roles: Sequence[str] = tables.USER_ROLES,
) -> tuple[Change, DataFrame]:
    """New users and the links for the codes they ask for.

    ``requests`` has request_id, nip, nama, password, role and codes. The first
    request of a new ``nip`` is accepted; status holds the reason of a refusal.
    """
    filled = requests.withColumn("role", or_default(F.col("role"), tables.USER_ROLE))
    judged = validate.validate_rows(
        filled, [*validate.required(*required), validate.one_of("role", roles)]
    )
    unique = change.insert_unique(users, judged.good, ["nip"], "request_id")
    keyed = change.assign_keys(
        unique.affected, "id", change.next_key(users, "id"), order_by=["request_id"]
    )
    added = change.append(users, keyed.drop("request_id", "codes"), now=now)
    asked = keyed.select(F.col("id").alias("user_id"), "codes")
    new_links, _ = access.assign_codes(added.affected, asked, permissions)
    status = unique.status.select("request_id", "reason").unionByName(
        judged.bad.select("request_id", F.array_join("errors", "; ").alias("reason"))
    )
    return Change(added.after, added.affected, status), links.unionByName(new_links)


def update_users(
    users: DataFrame,
    links: DataFrame,
    requests: DataFrame,
    now: object,
    roles: Sequence[str] = tables.USER_ROLES,
) -> tuple[Change, Change]:
    """Change roles and replace permission sets.

    ``requests`` has request_id, id, role and ids. A request with a role outside
    the domain or a repeated permission changes nothing at all.
    """
    bad_role = is_given(F.col("role")) & ~F.col("role").isin(list(roles))
    repeated = F.size(F.array_distinct("ids")) < F.size("ids")
    judged = validate.validate_rows(
        requests,
        [validate.Rule("role: not allowed", bad_role), validate.Rule("ids: repeated", repeated)],
    )
    good = judged.good
    changed = change.update_by_key(
        users, good, "id", ["role"], {"updated_at": now}, order_by="request_id"
    )
    sets = access.replace_set(
        links, good.withColumnRenamed("id", "user_id"), users, "request_id"
    )
    refused = judged.bad.select(*requests.columns, F.array_join("errors", "; ").alias("status"))
    return Change(changed.after, changed.affected, changed.status.unionByName(refused)), sets


def delete_users(
    registry: Mapping[str, DataFrame], requests: DataFrame, with_participants: bool = False
) -> dict[str, Change]:
    """Delete users by id with their links and activities.

    Requests (request_id, id) have the status ``deleted`` or ``not_found`` in
    the change of ``users``.
    """
    references = list(tables.USER_REFERENCES)
    if with_participants:
        references += tables.ACTIVITY_REFERENCES
    return delete.delete_cascade(registry, references, "users", requests, ["id"])


# --- teams ---------------------------------------------------------------


def list_teams(teams: DataFrame) -> DataFrame:
    return teams.orderBy("id")


def insert_teams(teams: DataFrame, rows: DataFrame, order_by: str) -> Change:
    """Insert named teams; a known or repeated name is refused."""
    unique = change.insert_unique(teams, rows, ["nama_tim"], order_by)
    keyed = change.assign_keys(
        unique.affected, "id", change.next_key(teams, "id"), order_by=[order_by]
    )
    added = change.append(teams, keyed.select("id", "nama_tim"))
    return Change(added.after, added.affected, unique.status)


def rename_teams(teams: DataFrame, requests: DataFrame, order_by: str) -> Change:
    """Rename teams, each request as the table stands when its turn comes."""
    return rename_unique(teams, requests, "id", "nama_tim", order_by)


def delete_teams(teams: DataFrame, requests: DataFrame, activities: DataFrame) -> Change:
    """Requests (request_id, id); a team that an activity uses stays."""
    return delete.delete_restricted(teams, requests, "id", activities, "team_id")


# --- clears --------------------------------------------------------------


def clear_staff(registry: Mapping[str, DataFrame]) -> delete.Truncation:
    """Empty the staff and restart their ids."""
    return delete.truncate(registry, "ptk")


def clear_schools(registry: Mapping[str, DataFrame]) -> delete.Truncation:
    """Empty the schools, and the staff that refer to them, and restart ids."""
    return delete.truncate(registry, "data_sekolah", tables.SCHOOL_REFERENCES)


def clear_candidates(registry: Mapping[str, DataFrame]) -> delete.Truncation:
    """Empty the candidates; ``already_empty`` if there are none."""
    return delete.truncate(registry, "ppg", refuse_empty=True)


def clear_activities(registry: Mapping[str, DataFrame]) -> delete.Truncation:
    """Empty the activities and their participants; ``already_empty`` if there are none."""
    return delete.truncate(registry, "kegiatan", tables.ACTIVITY_REFERENCES, refuse_empty=True)


# --- helpers -------------------------------------------------------------


def _load_upsert(
    spark: SparkSession,
    path: str,
    target: DataFrame,
    table: tables.UpsertTable,
    schema: T.StructType | None,
    rule: str,
) -> Change:
    # Parsed once and whole before anything is merged.
    staged = stage(_staged_file(spark, path, schema or table.schema, rule), "arrived")
    return change.upsert(target, staged, table.key, table.updates, [SOURCE_ORDER])


def _staged_file(spark: SparkSession, path: str, schema: T.StructType, rule: str) -> DataFrame:
    if _is_workbook(path):
        return workbook.rows_to_table(workbook.workbook_rows(spark, path, rule), schema)
    return csv.load_positional(spark, path, schema, source_order=SOURCE_ORDER)


def _in_source_order(staged: DataFrame, key: str, target: DataFrame) -> DataFrame:
    """The next keys of ``target`` for rows with a source order, which is dropped."""
    keyed = change.assign_keys(staged, key, change.next_key(target, key), [SOURCE_ORDER])
    return keyed.drop(SOURCE_ORDER)


def _is_workbook(path: str) -> bool:
    return path.lower().endswith(".xlsx")


def _activity_lookups(users: DataFrame, teams: DataFrame) -> list[Lookup]:
    return [
        Lookup(users, "users_id", "id", {"nama": "created_by"}, "inner"),
        Lookup(teams, "team_id", "id", {"nama_tim": "tim"}, "left"),
    ]


def _activity_page(
    activities: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    page: object,
    limit: object,
    total: str,
) -> Page:
    cut = listing.lookup_page(
        activities,
        _activity_lookups(users, teams),
        [("created_at", "desc")],
        "id",
        page,
        limit,
        total,
    )
    return Page(cut.page, cut.limit, cut.rows.select(*tables.ACTIVITY_LISTED), cut.summary)


def _school_staff(q: str) -> dict:
    return {
        "parent_key": "sekolah_id",
        "child_fk": "sekolah_id",
        "order": ["nama"],
        "child_key": "ptk_id",
        "terms": [("nama", "contains")],
        "q": q,
        "parent_columns": ["nama", "alamat_jalan", "email", "npsn"],
        "child_columns": tables.STAFF_SHOWN,
    }


def _school_names(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("nama").alias("sekolah_terpilih"),
        F.col("alamat_jalan").alias("alamat"),
        "email",
        "npsn",
        F.col("parent_id").alias("sekolah_id"),
        F.col("total").alias("totalData"),
        F.col("pages").alias("totalPages"),
        "page",
        "limit",
        F.col("data").alias("data_ptk"),
    )


def _insert(
    target: DataFrame,
    rows: DataFrame,
    key: str,
    now: object,
    order_by: Sequence[str] | None,
) -> Change:
    keyed = change.assign_keys(rows, key, change.next_key(target, key), order_by)
    kept = [c for c in target.columns if c in keyed.columns]
    return change.append(target, keyed.select(*kept), now=now)


def _number(value: object) -> int:
    number = leading_int_of(value)
    if number is None:
        raise ValueError(f"not a valid id: {value!r}")
    return number
