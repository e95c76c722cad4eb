import datetime
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from rollbook.operators import change, rename
from rollbook.operators.rename import rename_unique

SMALL = pytest.mark.parametrize("small", [0, 1 << 30])


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "k int, v string, keep string"
    )


def staged(spark, data):
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(data)], "k int, v string, keep string, o int"
    ).repartition(3)


@SMALL
def test_upsert(spark, target, small):
    batch = staged(spark, [(2, None, "n"), (9, "first", "n"), (9, "second", "m"), (3, "c", "n")])
    result = change.upsert(target, batch, ["k"], ["v"], ["o"], small=small)
    after = [(1, "a", "x"), (2, None, "y"), (3, "c", "z"), (9, "first", "n")]
    assert rows(result.after) == after
    assert rows(result.affected) == after[1:]
    assert result.after.columns == target.columns
    again = change.upsert(result.after, batch, ["k"], ["v"], ["o"], small=small)
    assert rows(again.after) == after


@SMALL
def test_upsert_into_empty_and_with_empty(spark, target, small):
    batch = staged(spark, [(1, "a", "b"), (1, "c", "d")])
    result = change.upsert(target.limit(0), batch, ["k"], ["v"], ["o"], small=small)
    assert rows(result.after) == [(1, "a", "b")]
    nothing = change.upsert(target, batch.limit(0), ["k"], ["v"], ["o"], small=small)
    assert rows(nothing.after) == rows(target)
    assert nothing.affected.count() == 0


@SMALL
def test_upsert_null_key(spark, target, small):
    batch = staged(spark, [(None, "a", "b")])
    with pytest.raises(Exception, match="null key"):
        change.upsert(target, batch, ["k"], ["v"], ["o"], small=small).after.collect()


def test_upsert_two_keys(spark):
    target = spark.createDataFrame([("u", "2023", "old")], "no string, tahun string, v string")
    batch = spark.createDataFrame(
        [("u", "2023", "new", 1), ("u", "2024", "other", 0)],
        "no string, tahun string, v string, o int",
    )
    result = change.upsert(target, batch, ["no", "tahun"], ["v"], ["o"])
    assert rows(result.after) == [("u", "2023", "new"), ("u", "2024", "other")]
    with pytest.raises(ValueError, match="not in target"):
        change.upsert(target, batch, ["no"], ["w"], ["o"])


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_dedupe_is_independent_of_partitions(spark, conf, partitions):
    conf(shuffle__partitions=partitions)
    df = spark.range(500).select((F.col("id") % 7).alias("k"), "id").repartition(partitions, F.rand(3))
    assert rows(change.dedupe_by_key(df, ["k"], ["id"])) == [(k, k) for k in range(7)]
    last = change.dedupe_by_key(df, ["k"], ["id"], keep="last")
    assert rows(last) == rows(df.groupBy("k").agg(F.max("id")))


def test_dedupe_needs_an_order(target):
    with pytest.raises(ValueError, match="needs an order"):
        change.dedupe_by_key(target, ["k"], [])
    with pytest.raises(ValueError, match="keep"):
        change.dedupe_by_key(target, ["k"], ["v"], keep="any")


def test_append(spark, target):
    now = datetime.datetime(2024, 1, 2)
    stamped = target.withColumn("created_at", F.lit(datetime.datetime(2000, 1, 1)))
    new = spark.createDataFrame([("", ), (None,), ("q",)], "keep string")
    result = change.append(stamped, new, {"k": 7}, {"keep": "d", "v": "w"}, now)
    assert rows(result.affected) == [(7, "w", "d", now), (7, "w", "d", now), (7, "w", "q", now)]
    assert result.after.count() == 6
    with pytest.raises(ValueError, match="target lacks"):
        change.append(target, new.withColumn("other", F.lit(1)))


def test_assign_keys(spark):
    df = spark.range(1000, numPartitions=7).select((1000 - F.col("id")).alias("n"))
    dense = change.assign_keys(df, "id", 10, order_by=["n"])
    assert dense.filter("id <> n + 10").count() == 0
    gapped = change.assign_keys(df, "id", 10)
    assert gapped.agg(F.countDistinct("id"), F.min("id")).first() == (1000, 11)
    assert change.next_key(dense, "id") == 1010
    assert change.next_key(dense.limit(0), "id") == 0


def test_update_by_key(spark):
    then, now = datetime.datetime(2000, 1, 1), datetime.datetime(2024, 1, 1)
    target = spark.createDataFrame(
        [(i, "user", then) for i in range(1, 6)], "id int, role string, updated_at timestamp"
    )
    changes = spark.createDataFrame(
        [(1, None, 0), (2, "", 1), (3, "admin", 2), (9, "admin", 3), (4, "x", 4), (4, "y", 6), (4, None, 7)],
        "id int, role string, seq int",
    )
    result = change.update_by_key(target, changes, "id", ["role"], {"updated_at": now}, order_by="seq")
    assert rows(result.after) == [
        (1, "user", then),
        (2, "user", then),
        (3, "admin", now),
        (4, "y", now),
        (5, "user", then),
    ]
    assert rows(result.affected, "id") == [(3,), (4,)]
    assert rows(result.status, "seq", "status") == [
        (0, "unchanged"),
        (1, "unchanged"),
        (2, "updated"),
        (3, "not_found"),
        (4, "updated"),
        (6, "updated"),
        (7, "unchanged"),
    ]


def test_update_with_empty_values(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, nama string")
    changes = spark.createDataFrame([(1, None), (2, "")], "id int, nama string")
    result = change.update_by_key(target, changes, "id", ["nama"], skip_empty=False)
    assert rows(result.after) == [(1, None), (2, "")]


def test_update_all(target):
    result = change.update_all(target, {"v": "same"})
    assert rows(result.after, "v") == [("same",)] * 3


def test_insert_unique(spark):
    target = spark.createDataFrame([(1, "n1")], "id int, nip string")
    new = spark.createDataFrame(
        [("n1", 0), ("n2", 3), ("n2", 1), ("", 4), (None, 5), ("n3", 6)], "nip string, seq int"
    )
    result = change.insert_unique(target, new, ["nip"], "seq")
    assert rows(result.status, "seq", "reason") == [
        (0, "known"),
        (1, None),
        (3, "repeated"),
        (4, "missing"),
        (5, "missing"),
        (6, None),
    ]
    assert rows(result.affected) == [("n2", 1), ("n3", 6)]
    assert rows(result.after) == [(1, "n1"), (None, "n2"), (None, "n3")]


def test_rename_unique(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, nama string")
    requests = spark.createDataFrame(
        [(0, 1, "b"), (1, 1, "d"), (2, 2, "d"), (3, 3, ""), (4, 9, "z"), (5, 3, "c"), (6, 1, "e")],
        "seq int, id int, nama string",
    )
    result = rename_unique(target, requests, "id", "nama", "seq")
    assert rows(result.status, "seq", "status") == [
        (0, "duplicate"),
        (1, "updated"),
        (2, "duplicate"),
        (3, "missing"),
        (4, "not_found"),
        (5, "updated"),
        (6, "updated"),
    ]
    assert rows(result.after) == [(1, "e"), (2, "b"), (3, "c")]


def one_by_one(names, requests):
    """The statuses and final names if each request is sent after the one before."""
    names, statuses = dict(names), []
    for seq, key, name in sorted(requests, key=lambda r: r[0]):
        if not name:
            status = "missing"
        elif key not in names:
            status = "not_found"
        elif any(v == name and k != key for k, v in names.items()):
            status = "duplicate"
        else:
            names[key], status = name, "updated"
        statuses.append((seq, status))
    return sorted(statuses, key=str), sorted(names.items(), key=str)


RENAMES = {
    "chain": ([(1, "A"), (2, "B"), (3, "C")], [(1, 1, "Z"), (2, 2, "A"), (3, 3, "B"), (4, 1, "C")]),
    "refused chain": ([(1, "A"), (2, "B"), (3, "C")], [(1, 1, "B"), (2, 2, "C"), (3, 3, "A"), (4, 3, "D"), (5, 2, "C"), (6, 1, "B")]),
    "swap": ([(1, "A"), (2, "B")], [(1, 1, "tmp"), (2, 2, "A"), (3, 1, "B")]),
    "again": ([(1, "A"), (2, "B")], [(1, 1, "A"), (2, 1, "B"), (3, 1, "A"), (4, 1, "C"), (5, 2, "A"), (6, 1, "A"), (7, 2, "A"), (8, 2, "B"), (9, 1, "A")]),
    "back": ([(1, "A")], [(1, 1, "B"), (2, 1, "A"), (3, 1, "B"), (4, 9, "A"), (5, 1, ""), (6, 1, None)]),
}


WAYS = pytest.mark.parametrize(("large", "folded"), [(1 << 20, 1000), (1 << 20, 0), (2, 0)])


@WAYS
def test_renames_count_one_by_one(spark, large, folded):
    """All cases in one batch, each with keys and names of its own."""
    names, requests = [], []
    for n, (held, asked) in enumerate(RENAMES.values()):
        names += [(10 * n + k, f"{n}{v}") for k, v in held]
        requests += [(10 * s + n, 10 * n + k, v and f"{n}{v}") for s, k, v in asked]
    target = spark.createDataFrame(names, "id int, nama string")
    batch = spark.createDataFrame(requests, "seq int, id int, nama string")
    result = rename_unique(target, batch, "id", "nama", "seq", large, folded)
    statuses, after = one_by_one(names, requests)
    assert rows(result.status, "seq", "status") == statuses
    assert rows(result.after) == after


def test_many_renames_of_few_names(spark):
    """A third of the requests want one name, which is handed on many times."""
    rng = random.Random(8)
    names = [(i, f"n{i}") for i in range(40)]
    requests = [(s, rng.randrange(44), rng.choice(["hot", f"n{rng.randrange(40)}", f"m{rng.randrange(60)}"])) for s in range(300)]
    target = spark.createDataFrame(names, "id int, nama string")
    batch = spark.createDataFrame(requests, "seq int, id int, nama string").repartition(4)
    result = rename_unique(target, batch, "id", "nama", "seq")
    statuses, after = one_by_one(names, requests)
    assert rows(result.status, "seq", "status") == statuses
    assert rows(result.after) == after


def test_no_renames(spark):
    target = spark.createDataFrame([(1, "A")], "id int, nama string")
    result = rename_unique(target, spark.createDataFrame([], "seq int, id int, nama string"), "id", "nama", "seq")
    assert rows(result.status) == [] and rows(result.after) == [(1, "A")]


def test_rename_rounds_write_no_names(spark, monkeypatch):
    """What the rounds write again and again has numbers for names, in whole batches folded or chained."""
    target = spark.createDataFrame([(i, f"name {i}") for i in range(6)], "id int, nama string")
    batch = [(n, n % 6, f"name {(n * 5 + n // 4) % 7}") for n in range(60)]
    written = []
    plain = rename.stage
    monkeypatch.setattr(rename, "stage", lambda df, label: written.append((label, df.schema)) or plain(df, label))
    for folded in (1000, 0):
        rename_unique(target, spark.createDataFrame(batch, "seq int, id int, nama string"), "id", "nama", "seq", folded=folded)
    rounds = [schema for label, schema in written if label in ("guess", "ends", "steps", "reached")]
    assert len(rounds) > 4
    assert not [f for schema in rounds for f in schema if f.dataType.simpleString() == "string"]
