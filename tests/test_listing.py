import pytest
from helpers import rows
from pyspark.sql import functions as F

from rollbook.operators import listing
from rollbook.operators.children import children_page, children_pages
from rollbook.operators.listing import Lookup
from rollbook.plans import order_columns


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ((None, None), (1, 10)),
        (("0", "0"), (1, 10)),
        (("abc", ""), (1, 10)),
        (("12abc", " 7"), (12, 7)),
        ((3, 5), (3, 5)),
    ],
)
def test_page_args(given, expected):
    assert listing.page_args(*given) == expected


def test_page_args_negative():
    with pytest.raises(ValueError, match="negative"):
        listing.page_args("-1")


@pytest.fixture(scope="module")
def people(spark):
    names = ["b", None, "a", "b", "c", "b", None]
    return spark.createDataFrame(list(enumerate(names)), "id int, nama string").repartition(5)


def test_null_order_and_tie_break(people):
    up = listing.page(people, ["nama"], "id", 1, 100).rows.collect()
    assert [r["id"] for r in up] == [2, 0, 3, 5, 4, 1, 6]
    down = listing.page(people, [("nama", "desc")], "id", 1, 100).rows.collect()
    assert [r["id"] for r in down] == [1, 6, 4, 0, 3, 5, 2]
    with pytest.raises(ValueError, match="direction"):
        order_columns([("nama", "up")])


def test_page_rows_and_summary(people):
    cut = listing.page(people, ["nama"], "id", 2, 3)
    assert [r["id"] for r in cut.rows.collect()] == [5, 4, 1]
    assert rows(cut.summary) == [(2, 3, 7, 3)]
    assert [r["total"] for r in cut.with_totals().collect()] == [7, 7, 7]
    data = cut.envelope().first()["data"]
    assert [r["id"] for r in data] == [5, 4, 1]


def test_page_past_the_end_and_empty(people):
    past = listing.page(people, ["nama"], "id", 9, 3)
    assert past.rows.count() == 0
    assert past.envelope().first()["data"] == []
    empty = listing.page(people.limit(0), ["nama"], "id")
    assert rows(empty.summary) == [(1, 10, 0, 0)]


@pytest.mark.parametrize("counted", [True, False])
def test_deep_page_equals_short_page(people, monkeypatch, counted):
    short = listing.page(people, [("nama", "desc")], "id", 2, 3).rows.collect()
    monkeypatch.setattr(listing, "FEW_ROWS", 0)
    if not counted:
        monkeypatch.setattr(listing, "rows_at", lambda *_: None)
    deep = listing.page(people, [("nama", "desc")], "id", 2, 3)
    assert deep.rows.collect() == short
    assert [r["id"] for r in deep.envelope().first()["data"]] == [r["id"] for r in short]


@pytest.mark.parametrize(("page", "limit"), [(1, 10), (3, 50), (2, 450), (4, 600)])
def test_pages_of_every_depth(spark, page, limit):
    df = spark.range(3000, numPartitions=20).select("id", (F.col("id") % 4).alias("nama"))
    cut = listing.page(df, [("nama", "desc")], "id", page, limit)
    expected = sorted(range(3000), key=lambda i: (-(i % 4), i))[(page - 1) * limit : page * limit]
    assert [r["id"] for r in cut.rows.collect()] == expected


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_all_pages_cover_and_do_not_overlap(spark, conf, partitions):
    conf(shuffle__partitions=partitions)
    df = spark.range(1003).select("id", (F.col("id") % 3).alias("nama"))
    df = df.repartition(partitions, F.rand(1))
    pages = listing.all_pages(df, [("nama", "desc")], "id", 10).collect()
    ordered = sorted(pages, key=lambda r: (r["page_no"], r["position"]))
    assert [r["id"] for r in ordered] == sorted(range(1003), key=lambda i: (-(i % 3), i))
    assert [(r["page_no"], r["position"]) for r in ordered] == [
        (i // 10 + 1, i % 10 + 1) for i in range(1003)
    ]


@pytest.fixture(scope="module")
def activities(spark):
    fact = spark.createDataFrame(
        [(1, 10, 7), (2, 10, None), (3, 99, 7), (4, 11, 70)], "id int, users_id int, team_id int"
    )
    users = spark.createDataFrame([(10, "Ani"), (11, None)], "id int, nama string")
    teams = spark.createDataFrame([(7, "T7")], "id int, nama_tim string")
    return fact, [
        Lookup(users, "users_id", "id", {"nama": "created_by"}, "inner"),
        Lookup(teams, "team_id", "id", {"nama_tim": "tim"}),
    ]


def test_lookups(activities):
    fact, lookups = activities
    expected = [(1, 10, 7, "Ani", "T7"), (2, 10, None, "Ani", None), (4, 11, 70, None, None)]
    assert rows(listing.with_lookups(fact, lookups)) == expected
    cut = listing.lookup_page(fact, lookups, ["id"], "id", 1, 10)
    assert [tuple(r) for r in cut.rows.collect()] == expected
    assert cut.summary.first()["total"] == 4
    joined = listing.lookup_page(fact, lookups, ["id"], "id", 2, 2, "joined")
    assert [r["id"] for r in joined.rows.collect()] == [4]
    assert rows(joined.summary) == [(2, 2, 3, 2)]
    with pytest.raises(ValueError, match="total"):
        listing.lookup_page(fact, lookups, ["id"], "id", total="other")


def test_by_key(spark, activities):
    fact, _ = activities
    wanted = spark.createDataFrame([(1,), (1,), (4,), (8,), (None,)], "k int")
    assert [r[0] for r in rows(listing.by_key(fact, "id", wanted))] == [1, 4]
    assert [r[0] for r in rows(listing.by_key(fact, "id", [2, 9]))] == [2]


def test_single_value(spark):
    df = spark.createDataFrame([("x",)], "isi string")
    assert rows(listing.single_value(df, "isi")) == [("x",)]
    assert rows(listing.single_value(df.limit(0), "isi")) == [("",)]
    empty = spark.createDataFrame([(None,)], "isi string")
    assert rows(listing.single_value(empty, "isi", "-")) == [("-",)]


@pytest.fixture(scope="module")
def family(spark):
    parent = spark.createDataFrame(
        [("A1", "one"), ("a1", "twin"), ("B2", "two"), ("C3", "three"), (None, "no key")],
        "sekolah_id string, sekolah string",
    )
    child = spark.createDataFrame(
        [("a1", i, f"n{i % 4}") for i in range(10)]
        + [("A1", 10, None), ("b2", 11, "x"), ("zz", 12, "lost"), (None, 13, "lost")],
        "sekolah_id string, ptk_id int, nama string",
    )
    return parent, child


KEYS = {"parent_key": "sekolah_id", "child_fk": "sekolah_id", "order": ["nama"], "child_key": "ptk_id"}


def expected_page(child, key, page, limit):
    mine = [r for r in child.collect() if r["sekolah_id"] and r["sekolah_id"].lower() == key]
    mine.sort(key=lambda r: (r["nama"] is None, r["nama"] or "", r["ptk_id"]))
    return len(mine), [r["ptk_id"] for r in mine[(page - 1) * limit : page * limit]]


@pytest.mark.parametrize(("page", "limit"), [(1, 4), (2, 4), (3, 4), (9, 4), (1, 1000)])
def test_children(family, page, limit):
    parent, child = family
    every = children_pages(parent, child, page_no=page, limit=limit, **KEYS).collect()
    assert sorted((r["parent_id"], r["sekolah"]) for r in every) == [
        ("a1", "one"),
        ("b2", "two"),
        ("c3", "three"),
    ]
    for row in every:
        total, keys = expected_page(child, row["parent_id"], page, limit)
        assert (row["total"], row["pages"]) == (total, -(-total // limit))
        assert [c["ptk_id"] for c in row["data"]] == keys
        one = children_page(
            parent, child, row["parent_id"].upper(), page_no=page, limit=limit, **KEYS
        ).first()
        assert one["sekolah"] == row["sekolah"]
        assert (one["total"], one["pages"]) == (row["total"], row["pages"])
        assert [c["ptk_id"] for c in one["data"]] == keys


def test_children_search_and_unknown_parent(family):
    parent, child = family
    found = children_pages(parent, child, terms=[("nama", "contains")], q="N1", **KEYS)
    assert {r["parent_id"]: r["total"] for r in found.collect()} == {"a1": 3, "b2": 0, "c3": 0}
    assert children_page(parent, child, "unknown", **KEYS).count() == 0
