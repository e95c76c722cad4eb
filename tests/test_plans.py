"""Ranking, skew and the physical plans the operators rely on."""

import datetime
import decimal
import math
import random
import re
from functools import partial

import pytest
from helpers import final_plan, rows
from pyspark.sql import functions as F

from rollbook.operators import access, delete
from rollbook.operators.change import dedupe_by_key, update_by_key, upsert
from rollbook.operators.children import children_pages
from rollbook.operators.delete import delete_by_key
from rollbook.operators.listing import Lookup, lookup_page, page, with_lookups
from rollbook.plans import (
    ranking,
    hint_by_size,
    measured_bytes,
    number_rows,
    rank_in_group,
    release,
    rows_at,
    rows_between,
    stage,
    stage_path,
    with_source_order,
)
from rollbook.plans import staging
from rollbook.plans.staging import shared_folder


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_number_rows_in_order(spark, conf, partitions):
    conf(shuffle__partitions=partitions)
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    numbered = number_rows(df.repartition(partitions), [F.col("k").desc()], unique=True)
    assert all(r["ordinal"] == 4999 - r["k"] for r in numbered.collect())


def test_number_rows_spreads_equal_rows(spark, conf):
    """Half of the table is copies of one row; no task gets them all."""
    conf(adaptive__coalescePartitions__enabled="false")
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"))
    numbered = number_rows(df, [F.col("k").asc()])
    assert numbered.agg(F.countDistinct("ordinal"), F.max("ordinal")).first() == (20_000, 19_999)
    copies = numbered.filter("k = -1").agg(F.min("ordinal"), F.max("ordinal")).first()
    assert tuple(copies) == (0, 9_999)
    tasks = [r["count"] for r in ranking._placed(df, [F.col("k").asc()], False, False).groupBy("_task").count().collect()]
    assert max(tasks) < 10_000


def test_number_rows_in_source_order(spark, tmp_path):
    for number, start in ((1, 0), (2, 700), (3, 800)):
        (tmp_path / f"f{number}.csv").write_text(
            "\n".join(str(i) for i in range(start, {1: 700, 2: 800, 3: 1500}[number])) + "\n"
        )
    df = spark.read.schema("k int").csv(str(tmp_path))
    assert all(r["ordinal"] == r["k"] for r in number_rows(df).collect())
    ordered = with_source_order(df).orderBy("source_order").collect()
    assert [r["k"] for r in ordered] == list(range(1500))
    assert "Exchange" not in with_source_order(df)._jdf.queryExecution().executedPlan().toString()


def test_source_order_of_other_frames(spark):
    df = spark.range(100, numPartitions=3).withColumn("x", F.col("id") + 1)
    assert [r["id"] for r in with_source_order(df).orderBy("source_order").collect()] == list(range(100))


@pytest.mark.parametrize("large", [10, 1_000_000])
@pytest.mark.parametrize("unique", [True, False])
def test_rank_in_group(spark, large, unique):
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 50).cast("string")).alias("g")
    )
    ranked = rank_in_group(df, ["g"], [F.col("id").desc()], unique=unique, large=large).collect()
    groups = {}
    for r in sorted(ranked, key=lambda r: -r["id"]):
        groups.setdefault(r["g"], []).append(r["rank"])
    assert len(ranked) == 6000
    assert all(ranks == list(range(1, len(ranks) + 1)) for ranks in groups.values())


def test_rank_of_hot_group_uses_several_tasks(spark, conf):
    conf(adaptive__coalescePartitions__enabled="false")
    df = spark.range(20_000).select("id", F.lit(1).alias("g"))
    plan = final_plan(rank_in_group(df, ["g"], [F.col("id").asc()], unique=True, large=100))
    assert not re.search(r"row_number", plan)


def test_dedupe_keeps_one_row_per_task_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = dedupe_by_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before


def test_children_page_is_cut_before_the_shuffle(spark):
    parent = spark.createDataFrame([("0",)], "p string")
    child = spark.range(100).select((F.col("id") % 2).cast("string").alias("fk"), "id")
    pages = children_pages(parent, child, "p", "fk", ["id"], "id", page_no=2, limit=5)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 10, Partial" in plan
    assert "count(" not in "".join(re.findall(r"Window \[.*", plan))


def test_page_is_a_top_k(spark):
    df = spark.range(100).select("id", F.lit("x").alias("wide"))
    plan = page(df, [("id", "desc")], "id", 3, 10).rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_reads_only_what_is_shown(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    users = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    lookups = [Lookup(users, "o_custkey", "c_custkey", {"c_name": "by"}, "inner")]
    cut = lookup_page(orders.select("o_orderkey", "o_custkey"), lookups, ["o_orderkey"], "o_orderkey")
    plan = cut.rows._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    assert "c_acctbal" not in plan


HOT = 30_000


@pytest.fixture
def skewed(spark, conf):
    """A third of all rows has one key; the lookup side may not be broadcast."""
    conf(
        autoBroadcastJoinThreshold=-1,
        adaptive__autoBroadcastJoinThreshold=-1,
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__skewJoin__skewedPartitionFactor=2,
        adaptive__advisoryPartitionSizeInBytes="20KB",
        shuffle__partitions=16,
    )
    return spark.range(3 * HOT).repartition(8).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("wide"),
    )


def test_lookup_join_splits_a_hot_key(spark, skewed):
    users = spark.range(1000).select("id", F.col("id").cast("string").alias("nama"))
    joined = with_lookups(skewed, [Lookup(users, "k", "id", {"nama": "by"}, "inner")])
    assert "skew=true" in final_plan(joined)
    assert joined.filter("by = cast(k AS string)").count() == 3 * HOT


def test_delete_splits_a_hot_key(spark, skewed, monkeypatch):
    monkeypatch.setattr("rollbook.operators.delete.hint_by_size", lambda df: lambda side: side)
    change = delete_by_key(skewed, spark.range(5).select(F.col("id").alias("k")), ["k"])
    assert "skew=true" in final_plan(change.after)
    assert change.after.count() + change.affected.count() == 3 * HOT


def test_deletes_of_many_keys_sort_no_table(spark):
    """Requests too large for a broadcast are hashed by the tasks; the table passes by them."""
    asked = spark.range(2_200_000).select(F.col("id").alias("request_id"), F.col("id").alias("k"))
    target = spark.range(0, 3_000_000, 1000).select(F.col("id").alias("k"))
    change = delete_by_key(target, asked, ["k"])
    free = delete.delete_restricted(target, asked, "k", target.filter("k < 1000000"), "k")
    for df, n in ((change.after, 800), (change.affected, 2200), (free.after, 1800), (free.affected, 1200)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert df.count() == n
    assert rows(change.status.groupBy("status").count()) == [("deleted", 2200), ("not_found", 2_197_800)]
    assert rows(free.status.groupBy("status").count()) == [("deleted", 1200), ("not_found", 2_197_800), ("refused", 1000)]


def test_hashed_keys_leave_hot_keys_to_be_split(spark, skewed, monkeypatch):
    monkeypatch.setattr("rollbook.operators.delete.hint_by_size", lambda df: lambda side: side.hint("shuffle_hash"))
    change = delete_by_key(skewed, spark.range(5).select(F.col("id").alias("k")), ["k"])
    plan = final_plan(change.after)
    assert "ShuffledHashJoin(skew=true)" in plan and "SortMergeJoin" not in plan
    assert change.after.count() + change.affected.count() == 3 * HOT


def test_only_what_fits_a_task_is_hashed(spark, conf):
    conf(shuffle__partitions=1)
    df = spark.range(100).repartition(2)
    assert "shuffle_hash" in hint_by_size(df, 10, hashed=True)(df)._jdf.queryExecution().logical().toString()
    assert hint_by_size(df, 10)(df) is df
    large = spark.range(9_000_000)
    assert hint_by_size(large, hashed=True)(large) is large


def test_restricted_deletes_take_shares_of_all_keys(spark, conf, monkeypatch):
    """Tasks follow the size of all keys, and each hashes those asked for only once."""
    conf(shuffle__partitions=2)
    monkeypatch.setattr("rollbook.plans.sizing.SHARE_BYTES", 16_000)
    monkeypatch.setattr("rollbook.operators.delete.hint_by_size", lambda df: lambda side: side.hint("shuffle_hash"))
    asked = spark.range(4000).select(F.col("id").alias("request_id"), (F.col("id") % 3000).alias("k"))
    target = spark.range(1000, 5000).select(F.col("id").alias("k"))
    child = spark.range(10_000).select((F.col("id") % 2000).alias("fk"))
    free = delete.delete_restricted(target, asked, "k", child, "fk")
    for df, n in ((free.after, 3000), (free.affected, 1000), (free.status, 4000)):
        assert df._jdf.queryExecution().executedPlan().toString().count("HashJoin") == 1
        assert df.rdd.getNumPartitions() == 18
        assert df.count() == n
    assert rows(free.affected) == sorted(((k,) for k in range(2000, 3000)), key=str)
    assert rows(free.status.groupBy("status").count()) == [("deleted", 1000), ("not_found", 2000), ("refused", 1000)]


def test_upsert_of_hot_key_keeps_one_row(spark, skewed):
    target = skewed.filter("id < 0")
    staged = skewed.withColumnRenamed("id", "seq")
    target = staged.select("k", "wide").filter("k < 0")
    for small in (0, 1 << 40):
        after = upsert(target, staged, ["k"], ["wide"], ["seq"], small=small).after
        assert after.count() == 1000
        first = staged.filter("k = 7").orderBy("seq").first()["wide"]
        assert after.filter("k = 7").first()["wide"] == first


def test_broadcast_needs_a_measured_bound(spark):
    df = spark.createDataFrame([("abc", [1, 2]), (None, None)], "t string, a array<int>")
    assert 0 < measured_bytes(df) < 1000
    assert measured_bytes(df.limit(0)) == 0
    small, large = hint_by_size(df), hint_by_size(df, limit=10)
    assert "broadcast" in small(df)._jdf.queryExecution().analyzed().toString().lower()
    assert large(df) is df


def test_upsert_does_not_shuffle_the_target_for_a_small_batch(spark, conf):
    conf(autoBroadcastJoinThreshold=-1)
    target = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    staged = target.limit(5)
    change = upsert(target, staged, ["o_orderkey"], ["o_totalprice"], ["o_totalprice"])
    plan = change.after._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_stage_uses_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert stage_path(spark, "x").startswith(folder)
    df = spark.range(10).withColumn("t", F.lit(None).cast("string"))
    assert rows(stage(df, "x")) == rows(df)


def test_number_rows_needs_an_order_or_an_unshuffled_scan(spark, tmp_path):
    spark.range(3000, numPartitions=3).write.parquet(str(tmp_path / "t"))
    scanned = spark.read.parquet(str(tmp_path / "t"))
    numbered = number_rows(scanned)
    assert rows(numbered.select("ordinal")) == sorted(((i,) for i in range(3000)), key=str)
    assert numbered.filter("id <> ordinal").isEmpty()
    with pytest.raises(ValueError, match="shuffled"):
        number_rows(scanned.repartition(5))
    with pytest.raises(ValueError, match="source order"):
        number_rows(spark.range(5))


def test_rows_between_reads_few_tasks(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("id"))
    found = rows_between(df.repartition(9), [F.col("id").desc()], 1200, 1210)
    assert rows(found) == sorted(((4999 - i,) for i in range(1200, 1210)), key=str)
    assert rows_between(df, [F.col("id").asc()], 6000, 6010).isEmpty()


@pytest.mark.parametrize("scanned", [True, False])
def test_number_rows_with_ties(spark, scanned):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")
    numbered = number_rows(df, [F.col("k").asc()], scanned=scanned).collect()
    assert sorted(r["ordinal"] for r in numbered) == list(range(3000))
    assert all(r["ordinal"] // 1000 == r["k"] for r in numbered)


def test_longer_page_reads_its_range(spark, tmp_path):
    spark.range(5000, numPartitions=20).select("id", F.lit("x").alias("wide")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cut = page(df, [("id", "desc")], "id", 3, 100).rows
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id," in plan
    assert "TakeOrderedAndProject" in plan
    assert "Join" not in plan and "rangepartitioning" not in plan
    assert [r["id"] for r in cut.collect()] == list(range(4799, 4699, -1))


@pytest.mark.parametrize("counted", [True, False])
def test_no_wide_column_of_a_far_page_is_staged(spark, monkeypatch, counted):
    """Nothing is staged if ranges are counted, and only keys where a sort finds the page."""
    staged = []
    monkeypatch.setattr("rollbook.plans.ranking.stage", lambda df, label: staged.append(df.columns) or stage(df, label))
    if not counted:
        monkeypatch.setattr("rollbook.operators.listing.rows_at", lambda *_: None)
    df = spark.range(30_000).select("id", F.lit("x").alias("wide"))
    cut = page(df, [("id", "desc")], "id", 2_000, 10).rows
    assert [r["id"] for r in cut.collect()] == list(range(10_009, 9_999, -1))
    assert counted != bool(staged) and not any("wide" in columns for columns in staged)


class FakeSession:
    def __init__(self, **settings):
        self.settings = settings
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_stage_folder_is_never_local_on_a_cluster():
    assert shared_folder(FakeSession(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession(spark_master="spark://host"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession(spark_master="spark://host", spark_sql_warehouse_dir="/tmp/x"))
    assert shared_folder(FakeSession(spark_master="local[2]", spark_sql_warehouse_dir="/w")) == "/w"


def test_released_stages_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path))
    stage(spark.range(3), "t")
    stage(spark.range(3), "t")
    assert len(list((tmp_path / "rollbook").glob("*/t-*"))) == 2
    release(spark)
    assert list((tmp_path / "rollbook").glob("*/*")) == []
    assert stage(spark.range(3), "t").count() == 3


def test_batches_are_reduced_by_hash(spark):
    target = spark.range(50).select("id", F.lit("a").alias("role"))
    changes = target.select("id", F.lit("b").alias("role"), F.col("id").alias("seq"))
    change = update_by_key(target, changes, "id", ["role"], order_by="seq")
    assert "SortAggregate" not in final_plan(change.after)
    links = target.select(F.col("id").alias("user_id"), F.col("id").alias("permission_id"))
    asked = links.select("user_id", F.array("permission_id").alias("ids"), F.col("user_id").alias("seq"))
    replaced = access.replace_set(links, asked, target, "seq")
    assert "SortAggregate" not in final_plan(replaced.after)


def test_codes_of_a_hot_user(spark, skewed):
    """One row per user however many codes; in rows, a hot user spans tasks."""
    users = spark.range(1000).select("id", F.lit("x").alias("nama"))
    links = skewed.select(F.col("k").alias("user_id"), F.col("id").alias("permission_id"))
    permissions = skewed.select("id", F.col("wide").alias("code"))
    found = access.codes_per_user(users, links.union(links), permissions)
    assert found.count() == 1000
    n_hot = skewed.filter("k = 7").count()
    assert found.filter("id = 7").select(F.size("codes")).first()[0] == n_hot
    ranked = access.codes_in_rows(links, permissions)
    hot = ranked.filter("user_id = 7").orderBy("position").collect()
    assert [r["position"] for r in hot] == list(range(1, n_hot + 1))
    assert [r["code"] for r in hot] == sorted(r["code"] for r in hot)


def test_requests_for_one_hot_row(spark, conf, skewed, monkeypatch):
    """A third of all requests ask for one row; the requests are not broadcast."""
    for module in ("delete", "access"):
        monkeypatch.setattr(f"rollbook.operators.{module}.hint_by_size", lambda df: lambda side: side)
    requests = skewed.select(
        F.col("id").alias("request_id"),
        "k",
        (F.col("id") % 100).alias("user_id"),
        F.lit("user").alias("role"),
    )
    target = spark.range(1000).select(F.col("id").alias("k"), F.lit(5).alias("owner"))
    scoped = delete.delete_scoped(target, requests, "k", "owner")
    asked = {(r["k"], r["user_id"]): r["n"] for r in
             requests.groupBy("k", "user_id").agg(F.min("request_id").alias("n")).collect()}
    firsts = sorted((n,) for (_, user), n in asked.items() if user == 5)
    assert sorted(map(tuple, scoped.status.filter("status = 'deleted'").select("request_id").collect())) == firsts
    assert scoped.after.count() == 1000 - len(firsts)

    group = delete.delete_group(skewed.select("k", "id"), requests, target, "k", "k", "owner")
    assert rows(group.status.groupBy("status").count()) == [
        ("already_empty", requests.filter("user_id = 5").count() - len(firsts)),
        ("deleted", len(firsts)),
        ("refused", requests.filter("user_id <> 5").count()),
    ]
    assert group.status.agg(F.sum("rows")).first()[0] == group.affected.count()

    free = delete.delete_restricted(target, requests, "k", spark.range(500).toDF("fk"), "fk")
    assert free.after.count() == 500
    assert free.status.filter("status = 'deleted'").count() == 500

    users = target.select(F.col("k").alias("id"))
    links = skewed.select(F.col("k").alias("user_id"), F.col("id").alias("permission_id"))
    wanted = requests.select("request_id", F.col("k").alias("user_id"), F.array("request_id").alias("ids"))
    replaced = access.replace_set(links, wanted, users, "request_id")
    last = requests.groupBy("k").agg(F.max("request_id"))
    assert rows(replaced.after) == rows(last)


ORDERED = "k int, i long, d double, s string, t timestamp, day date, b boolean, m decimal(20,4)"


@pytest.fixture(scope="module")
def ordered(spark):
    rng = random.Random(6)
    day = datetime.date(1969, 12, 25)

    def maybe(value):
        return None if rng.random() < 0.15 else value

    rows_ = [
        (
            k, maybe(rng.choice([0, 1, -(1 << 63), (1 << 63) - 1, rng.randrange(-50, 50)])),
            maybe(rng.choice([math.nan, math.inf, -math.inf, 0.0, 1e300, -1e300, 5e-324, rng.random()])),
            maybe(rng.choice(["", "a", "ab", "ab\0", "aé", "z" * 40, "z" * 40 + "y", "日本", "😀", str(rng.randrange(40))])),
            maybe(datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**14))),
            maybe(day + datetime.timedelta(days=rng.randrange(20))), maybe(rng.random() < 0.5),
            maybe(decimal.Decimal(rng.randrange(-10**6, 10**6)) / 100),
        )
        for k in range(90)
    ]
    return stage(spark.createDataFrame(rows_, ORDERED).repartition(3), "ordered")


@pytest.mark.parametrize(
    ("column", "direction"),
    [("i", "asc"), ("d", "desc"), ("d", "asc"), ("s", "asc"), ("s", "desc"), ("t", "desc"), ("day", "asc"), ("b", "desc"), ("m", "asc")],
)
def test_rows_found_by_counting(ordered, column, direction):
    sort = F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_first()
    keys = [r["k"] for r in ordered.orderBy(sort, F.col("k").desc()).select("k").collect()]
    for first, last, few, ranges in ((41, 45, 3, 3), (60, 999, 40, 1024)):
        found = rows_at(ordered, [(F.col(column), direction), (F.col("k"), "desc")], first, last, few, ranges)
        assert {r["k"] for r in found.select("k").collect()} == set(keys[first:last])


def test_rows_at_uses_no_table_and_no_range_shuffle(spark, tmp_path):
    path = str(tmp_path / "sorted")
    spark.range(200_000).select("id", (F.col("id") % 7).alias("g"), F.lit("x").alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    found = rows_at(df, [(F.col("id"), "desc")], 150_000, 150_010)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "GreaterThanOrEqual(id," in plan
    assert sorted(r["id"] for r in found.collect()) == list(range(49_990, 50_000))
    by_group = rows_at(df, [(F.col("g"), "asc"), (F.col("id"), "asc")], 199_995, 200_005)
    assert sorted(r["id"] for r in by_group.collect()) == [199_968 + 7 * i for i in range(5)]


def test_rows_at_without_ranges(spark):
    df = spark.range(9).select(F.array("id").alias("a"), "id")
    assert rows_at(df, [(F.col("a"), "asc")], 0, 2) is None
    assert rows(page(df, ["a"], "id", 52, 2).rows) == [] and page(df, [("a", "desc")], "id", 1, 200).rows.count() == 9
    empty = df.filter("id < 0").select("id")
    assert rows_at(empty, [(F.col("id"), "asc")], 500, 510).count() == 0
