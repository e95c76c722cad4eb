"""Runs of ordered rows of every group against sorting each group."""

import datetime
import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from rollbook.operators.children import children_pages
from rollbook.plans import run_of_each_group

SCHEMA = "g string, name string, day date, n long, key long"


def _some_rows():
    rng = random.Random(3)
    names = ["", "a", "ab", "abc", "abd", "b", "é", "中", "abc" * 9, "abc" * 9 + "x", None]
    days = [None, *(datetime.date(2020, 1, 1) + datetime.timedelta(d) for d in (0, 1, 2, 900))]
    numbers = [None, 0, -1, 1, 2**62, -(2**63), 2**63 - 1, 7, 8]
    groups = ["hot"] * 6 + ["warm"] * 3 + ["cold", None]
    return [(rng.choice(groups), rng.choice(names), rng.choice(days), rng.choice(numbers), i) for i in range(900)]


ROWS = _some_rows()


def _sorted(rows, order):
    def compare(a, b):
        for at, direction in order:
            x, y = a[at], b[at]
            if x == y:
                continue
            if x is None or y is None:
                return (1 if x is None else -1) * (1 if direction == "asc" else -1)
            if isinstance(x, str):
                x, y = x.encode(), y.encode()
            return (-1 if x < y else 1) * (1 if direction == "asc" else -1)
        return 0

    return sorted(rows, key=cmp_to_key(compare))


@pytest.mark.parametrize(
    ("order", "first", "last"),
    [
        ([(1, "asc"), (4, "asc")], 0, 40),
        ([(1, "desc"), (2, "asc"), (4, "desc")], 120, 150),
        ([(3, "asc"), (1, "asc"), (4, "asc")], 200, 203),
        ([(3, "desc"), (4, "asc")], 480, 520),
        ([(2, "desc"), (3, "desc"), (1, "desc"), (4, "desc")], 77, 99),
    ],
)
@pytest.mark.parametrize(("few", "ranges"), [(3, 4), (1_000, 1024)])
def test_runs_equal_sorted_groups(spark, order, first, last, few, ranges):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    columns = [(F.col(df.columns[at]), d) for at, d in order]
    got = run_of_each_group(df, "g", columns, first, last, few=few, ranges=ranges).collect()
    want = []
    for g in ("hot", "warm", "cold"):
        own = _sorted([r for r in ROWS if r[0] == g], order)
        want += [(*r, i + 1) for i, r in enumerate(own[:last]) if i >= first]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rows_equal_in_all_columns(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("a", 2)] * 3 + [("b", 1)], "g string, n long")
    got = run_of_each_group(df, "g", [(F.col("n"), "asc")], 10, 52, few=4).collect()
    assert sorted((r["g"], r["n"], r["rank"]) for r in got) == [("a", 1 if i <= 50 else 2, i) for i in range(11, 53)]


def test_columns_without_ranges_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.5)], "g string, x double")
    assert run_of_each_group(df, "g", [(F.col("x"), "asc")], 0, 5) is None
    none = spark.createDataFrame([], SCHEMA)
    assert run_of_each_group(none, "g", [(F.col("name"), "asc"), (F.col("key"), "asc")], 0, 5).collect() == []


def test_deep_page_of_a_hot_parent_moves_only_its_ranges(spark):
    """Of 60,000 children of one parent and 1,000 others, few reach the ranking."""
    child = spark.range(61_000).select(
        F.col("id"),
        F.when(F.col("id") < 60_000, "Hot").otherwise("cold").alias("fk"),
        ((F.col("id") * 7919) % 61_000).alias("place"),
    )
    parent = spark.createDataFrame([("HOT",), ("cold",), ("none",)], "p string")
    pages = children_pages(parent, child, "p", "fk", ["place"], "id", page_no=41, limit=1_000)
    rows = {r["parent_id"]: r for r in pages.collect()}
    own = sorted((i * 7919 % 61_000, i) for i in range(60_000))
    assert [c["id"] for c in rows["hot"]["data"]] == [i for _, i in own[40_000:41_000]]
    assert (rows["hot"]["total"], rows["cold"]["total"], rows["none"]["total"]) == (60_000, 1_000, 0)
    assert rows["cold"]["data"] == [] == rows["none"]["data"]
    moved = run_of_each_group(
        child, "fk", [(F.col("place"), "asc"), (F.col("id"), "asc")], 40_000, 41_000, "_rank"
    )
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "RepartitionByExpression" not in plan
