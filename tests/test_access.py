import pytest
from helpers import rows
from pyspark.sql import functions as F

from rollbook.operators import access


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(
        [(1, "admin"), (2, "user"), (3, None), (4, "user")], "id bigint, role string"
    )


@pytest.fixture(scope="module")
def permissions(spark):
    return spark.createDataFrame([(7, "b"), (8, "a"), (9, None)], "id bigint, code string")


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(
        [(2, 7), (2, 8), (2, 9), (3, 9), (2, 70)], "user_id bigint, permission_id bigint"
    )


def test_codes_per_user(users, links, permissions):
    found = access.codes_per_user(users, links, permissions)
    assert rows(found, "id", F.to_json("codes")) == [
        (1, "[]"),
        (2, '["a","b"]'),
        (3, "[]"),
        (4, "[]"),
    ]
    some = access.codes_per_user(users, links.union(links), permissions, [2, 9])
    assert rows(some, "id", F.to_json("codes")) == [(2, '["a","b"]')]


def test_codes_of_a_user_with_many(spark, users, monkeypatch):
    permissions = spark.range(2500).select("id", F.format_string("c%05d", "id").alias("code"))
    links = permissions.select(F.lit(2).cast("bigint").alias("user_id"), F.col("id").alias("permission_id"))
    found = access.codes_per_user(users, links, permissions)
    assert found.filter("id = 2").first()["codes"] == [f"c{i:05d}" for i in range(2500)]
    assert found.count() == 4
    monkeypatch.setattr(access, "MOST_CODES", 2000)
    with pytest.raises(Exception, match="more than 2000 codes"):
        access.codes_per_user(users, links, permissions).collect()


def test_permission_codes(links, permissions):
    assert rows(access.permission_codes(links, permissions)) == [
        (2, "a"),
        (2, "b"),
        (2, None),
        (3, None),
    ]
    assert rows(access.permission_codes(links, permissions, [3])) == [(3, None)]


def test_has_access(users, links):
    found = access.has_access(users, links)
    assert rows(found, "id", "allowed") == [(1, True), (2, True), (3, True), (4, False)]


def test_replace_set(spark, users, links):
    requests = spark.createDataFrame(
        [
            (0, 2, None),
            (1, 3, []),
            (2, 4, [5, 6]),
            (3, 4, [7, 7]),
            (4, 1, [1]),
            (5, 1, [2, 3]),
            (6, 99, [1]),
        ],
        "request_id int, user_id bigint, ids array<bigint>",
    )
    result = access.replace_set(links, requests, users, "request_id")
    assert rows(result.status, "request_id", "status") == [
        (0, "untouched"),
        (1, "applied"),
        (2, "applied"),
        (3, "rejected"),
        (4, "applied"),
        (5, "applied"),
        (6, "not_found"),
    ]
    assert rows(result.affected) == [(1, 2), (1, 3), (4, 5), (4, 6)]
    assert rows(result.after.filter("user_id IN (2, 3)")) == rows(links.filter("user_id = 2"))


def test_assign_codes(spark, users, permissions):
    requests = spark.createDataFrame(
        [(1, ["a", "zz", "a", None]), (1, ["b"]), (3, []), (4, None), (99, ["a"])],
        "user_id bigint, codes array<string>",
    )
    links, status = access.assign_codes(users, requests, permissions)
    assert rows(links) == [(1, 7), (1, 8)]
    assert rows(status.groupBy("status").count()) == [("assigned", 4), ("not_found", 1)]
