import random

import pytest
from helpers import rows

from rollbook.operators import delete
from rollbook.operators.delete import Reference


@pytest.fixture(scope="module")
def activities(spark):
    return spark.createDataFrame([(1, 10), (2, 11), (3, 10), (4, None)], "id int, users_id int")


@pytest.fixture(scope="module")
def participants(spark):
    return spark.createDataFrame(
        [(100, 1), (101, 1), (102, 2), (103, 9), (104, None)], "peserta_id int, kegiatan_id int"
    )


def requests(spark, key, data):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(data)], f"request_id int, {key} int, user_id int, role string"
    )


def test_delete_by_key(spark, participants):
    wanted = spark.createDataFrame([(1,), (1,), (7,), (None,)], "kegiatan_id int")
    result = delete.delete_by_key(participants, wanted, ["kegiatan_id"])
    assert rows(result.affected) == [(100, 1), (101, 1)]
    assert rows(result.after.unionByName(result.affected)) == rows(participants)


def test_delete_scoped_by_own_column(spark, activities):
    asked = requests(
        spark,
        "id",
        [(1, 99, "admin"), (2, 11, "user"), (3, 11, "user"), (8, 10, "admin"), (1, 10, "user"),
         (4, 10, "user"), (4, None, None), (None, 10, "admin")],
    )
    result = delete.delete_scoped(activities, asked, "id", "users_id")
    assert rows(result.status, "request_id", "status") == [
        (0, "deleted"),
        (1, "deleted"),
        (2, "refused"),
        (3, "refused"),
        (4, "refused"),
        (5, "refused"),
        (6, "refused"),
        (7, "refused"),
    ]
    assert rows(result.after, "id") == [(3,), (4,)]
    assert rows(result.affected, "id") == [(1,), (2,)]


def test_delete_scoped_by_parent(spark, activities, participants):
    asked = requests(
        spark, "peserta_id", [(100, 10, "user"), (102, 10, "user"), (103, 10, "user"), (103, 1, "admin")]
    )
    result = delete.delete_scoped(
        participants, asked, "peserta_id", "users_id", activities, ("kegiatan_id", "id")
    )
    assert [r[1] for r in rows(result.status, "request_id", "status")] == [
        "deleted",
        "refused",
        "refused",
        "deleted",
    ]
    assert rows(result.after, "peserta_id") == [(101,), (102,), (104,)]


def test_delete_group(spark, activities, participants):
    asked = requests(
        spark,
        "kegiatan_id",
        [(1, 11, "user"), (1, 10, "user"), (1, 10, "user"), (3, 10, "user"), (3, 11, "user"),
         (77, 1, "admin"), (9, 1, "admin"), (9, 10, "user")],
    )
    result = delete.delete_group(participants, asked, activities, "kegiatan_id", "id", "users_id")
    assert rows(result.status, "request_id", "status", "rows") == [
        (0, "refused", 0),
        (1, "deleted", 2),
        (2, "already_empty", 0),
        (3, "already_empty", 0),
        (4, "refused", 0),
        (5, "already_empty", 0),
        (6, "deleted", 1),
        (7, "refused", 0),
    ]
    assert rows(result.after, "peserta_id") == [(102,), (104,)]
    assert rows(result.after.unionByName(result.affected)) == rows(participants)


def test_delete_restricted(spark, activities):
    teams = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "id int, nama_tim string")
    asked = spark.createDataFrame([(0, 10), (1, 12), (2, 12), (3, 50)], "request_id int, id int")
    result = delete.delete_restricted(teams, asked, "id", activities, "users_id")
    assert rows(result.status, "request_id", "status") == [
        (0, "refused"),
        (1, "deleted"),
        (2, "not_found"),
        (3, "not_found"),
    ]
    assert rows(result.after, "id") == [(10,), (11,)]


@pytest.mark.parametrize("hint", ["broadcast", "shuffle_hash", "merge"])
def test_delete_restricted_with_empty_keys(spark, monkeypatch, hint):
    """Keys that are null match nothing, whatever the join; keys may differ in type and repeat."""
    if hint != "broadcast":
        monkeypatch.setattr("rollbook.operators.delete.hint_by_size", lambda df: lambda side: side.hint(hint))
    teams = spark.createDataFrame([(10,), (11,), (12,), (None,)], "id int")
    asked = spark.createDataFrame(
        [(0, None), (1, 12), (2, 10), (3, 12), (4, 50), (5, 51), (6, None)], "request_id int, id bigint"
    )
    players = spark.createDataFrame([(10,), (10,), (51,), (None,), (11,)], "team smallint")
    result = delete.delete_restricted(teams, asked, "id", players, "team")
    assert rows(result.status, "request_id", "status") == [
        (0, "not_found"), (1, "deleted"), (2, "refused"), (3, "not_found"),
        (4, "not_found"), (5, "not_found"), (6, "not_found"),
    ]
    assert rows(result.after) == [(10,), (11,), (None,)]
    assert rows(result.affected) == [(12,)]
    assert result.after.schema == teams.schema


REFERENCES = [
    Reference("kegiatan", "users_id", "users", "id"),
    Reference("links", "user_id", "users", "id"),
    Reference("peserta", "kegiatan_id", "kegiatan", "id"),
]


@pytest.fixture(scope="module")
def registry(spark, activities, participants):
    return {
        "users": spark.createDataFrame([(10,), (11,)], "id int"),
        "links": spark.createDataFrame([(10, 1), (11, 1)], "user_id int, permission_id int"),
        "kegiatan": activities,
        "peserta": participants,
        "ptk": spark.createDataFrame([(1,)], "ptk_id int"),
    }


def test_delete_cascade(spark, registry):
    asked = spark.createDataFrame([(10,), (33,)], "id int")
    result = delete.delete_cascade(registry, REFERENCES, "users", asked, ["id"])
    assert set(result) == {"users", "links", "kegiatan", "peserta"}
    assert rows(result["users"].after) == [(11,)]
    assert rows(result["links"].after) == [(11, 1)]
    assert rows(result["kegiatan"].after, "id") == [(2,), (4,)]
    assert rows(result["peserta"].affected, "peserta_id") == [(100,), (101,)]
    for name, change in result.items():
        assert rows(change.after.unionByName(change.affected)) == rows(registry[name])


def test_delete_cascade_over_two_paths(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,)], "id int"),
        "b": spark.createDataFrame([(1, 1), (2, 2)], "id int, a int"),
        "c": spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 2, 2)], "id int, a int, b int"),
    }
    references = [
        Reference("c", "a", "a", "id"),
        Reference("c", "b", "b", "id"),
        Reference("b", "a", "a", "id"),
    ]
    asked = spark.createDataFrame([(1,)], "id int")
    result = delete.delete_cascade(tables, references, "a", asked, ["id"])
    assert rows(result["c"].affected, "id") == [(1,), (2,)]


def gone_below(tables, references, name, asked):
    """Row numbers of each table that go, one at a time."""
    gone = {t: set() for t in tables}
    gone[name] = {i for i, r in enumerate(tables[name]) if r["id"] in asked}
    while True:
        more = [
            (ref.child, i)
            for ref in references
            for i, r in enumerate(tables[ref.child])
            if i not in gone[ref.child]
            and r[ref.fk] is not None
            and r[ref.fk] in {tables[ref.parent][j][ref.key] for j in gone[ref.parent]}
        ]
        if not more:
            return gone
        for t, i in more:
            gone[t].add(i)


CYCLES = {
    "self": [Reference("a", "up", "a", "id")],
    "two tables": [Reference("b", "a", "a", "id"), Reference("a", "b", "b", "id")],
    "both": [Reference("a", "up", "a", "id"), Reference("b", "a", "a", "id"), Reference("a", "b", "b", "id"), Reference("c", "b", "b", "id"), Reference("c", "a", "a", "id")],
}


@pytest.mark.parametrize("case", CYCLES)
def test_delete_cascade_along_cycles(spark, case):
    rng = random.Random(4)

    def key():
        return rng.choice([None, rng.randrange(60)])

    held = {
        "a": [{"id": i, "up": i if i % 9 == 0 else key(), "b": key()} for i in range(40)],
        "b": [{"id": i, "a": key()} for i in range(40)] + [{"id": 3, "a": 1}],
        "c": [{"id": i, "a": key(), "b": key()} for i in range(40)],
    }
    schemas = {"a": "id int, up int, b int", "b": "id int, a int", "c": "id int, a int, b int"}
    tables = {t: spark.createDataFrame([tuple(r.values()) for r in rs], schemas[t]) for t, rs in held.items()}
    asked = spark.createDataFrame([(0, 1), (1, 7), (2, 99), (3, 7)], "request_id int, id int")
    result = delete.delete_cascade(tables, CYCLES[case], "a", asked, ["id"])
    gone = gone_below(held, CYCLES[case], "a", {1, 7})
    for name, change in result.items():
        assert rows(change.affected) == sorted((tuple(held[name][i].values()) for i in gone[name]), key=str)
        assert rows(change.after.unionByName(change.affected)) == rows(tables[name])
    assert set(result) == {"a"} | {r.child for r in CYCLES[case]}
    assert rows(result["a"].status, "request_id", "status") == [(0, "deleted"), (1, "deleted"), (2, "not_found"), (3, "not_found")]


def test_truncate_along_a_cycle(spark):
    tables = {t: spark.range(2) for t in ("a", "b", "c")}
    result = delete.truncate(tables, "a", CYCLES["two tables"])
    assert {t: df.count() for t, df in result.tables.items()} == {"a": 0, "b": 0, "c": 2}


def test_truncate(registry):
    result = delete.truncate(registry, "kegiatan", REFERENCES)
    assert result.status == "deleted"
    assert {n: df.count() for n, df in result.tables.items()} == {
        "users": 2,
        "links": 2,
        "kegiatan": 0,
        "peserta": 0,
        "ptk": 1,
    }
    assert result.next_ids == {"kegiatan": 1, "peserta": 1}


def test_truncate_of_an_empty_table(registry):
    empty = {**registry, "kegiatan": registry["kegiatan"].limit(0)}
    refused = delete.truncate(empty, "kegiatan", REFERENCES, refuse_empty=True)
    assert (refused.status, refused.next_ids) == ("already_empty", {})
    assert refused.tables["peserta"].count() == 5
    assert delete.truncate(empty, "kegiatan", REFERENCES).status == "deleted"
