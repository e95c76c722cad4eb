import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from rollbook.operators import split, stats, validate
from rollbook.sources import csv, store


def test_validate_rows(spark):
    df = spark.createDataFrame(
        [
            ("1", "n", "5", "5", "admin"),
            ("2", " ", "6", "5", None),
            ("x", "", "6", "y", "boss"),
            ("3abc", None, None, "5", "user"),
        ],
        "id string, nama string, total string, target string, role string",
    )
    parent = spark.createDataFrame([("1",), ("1",), ("2",)], "k string")
    rules = [
        *validate.required("nama"),
        validate.not_greater("total", "target"),
        validate.is_int("id"),
        validate.one_of("role", ["admin", "user"]),
        validate.exists_in("id", parent, "k"),
    ]
    result = validate.validate_rows(df, rules)
    assert rows(result.good, "id") == [("1",)]
    assert {r["id"]: r["errors"] for r in result.bad.collect()} == {
        "2": ["total: exceeds target"],
        "x": ["nama: missing", "id: not a number", "role: not allowed", "id: not found"],
        "3abc": ["nama: missing", "id: not found"],
    }
    assert rows(result.good.unionByName(result.bad.drop("errors"))) == rows(df)


def test_distribution(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", 2)], "x string, y int")
    assert rows(stats.distribution(df, ["x", "y"])) == sorted(
        [
            ("x", "a", 2, 0.5),
            ("x", "b", 1, 0.25),
            ("x", None, 1, 0.25),
            ("y", "1", 2, 0.5),
            ("y", "2", 1, 0.25),
            ("y", None, 1, 0.25),
        ],
        key=str,
    )
    assert stats.distribution(df.limit(0), ["x"]).count() == 0


def test_feed(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    shown, total = stats.feed(df, ["c", "a"])
    assert rows(shown) == [(3, 1)]
    assert rows(total) == [(1,)]


@pytest.mark.parametrize(("count", "parts"), [(0, 0), (1, 1), (999, 1), (1000, 1), (1001, 2), (2500, 3)])
def test_parts_have_the_exact_size(spark, count, parts):
    df = spark.range(count, numPartitions=5).select((-F.col("id")).alias("k"))
    manifest = split.part_manifest(split.split_parts(df, ["k"]), "b").orderBy("part").collect()
    sizes = [1000] * (count // 1000) + ([count % 1000] if count % 1000 else [])
    assert [r["n"] for r in manifest] == sizes
    assert [r["name"] for r in manifest] == [f"b_part{i + 1}.csv" for i in range(parts)]


def test_written_parts_concatenate_to_the_input(spark, tmp_path):
    df = spark.range(2345).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit('a "q", '), F.col("id"), F.lit("\nb"))).alias("t"),
    )
    path = str(tmp_path / "out")
    split.write_parts(split.split_parts(df.repartition(7), ["k"]), path, "base")
    found = []
    for number in (1, 2, 3):
        folder = f"{path}/name=base_part{number}.csv"
        files = [f for f in os.listdir(folder) if f.endswith(".csv")]
        assert len(files) == 1
        assert open(f"{folder}/{files[0]}").readline() == "k,t\n"
        part = csv.load_positional(spark, folder, df.schema, source_order="o")
        found += [(r["k"], r["t"]) for r in part.orderBy("o").collect()]
    assert found == [tuple(r) for r in df.orderBy("k").collect()]


TEXTS = [" a ", "\tb\t", "c\rd", "#e", "f\\g", '"', '""', ",", ";", "'h'", "\n", "  ", "é\u00a0"]


def test_written_texts_read_back(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    path = str(tmp_path / "out")
    split.write_parts(split.split_parts(df, ["k"], 5), path, "b")
    back = csv.load_positional(spark, f"{path}/*", df.schema)
    assert rows(back) == rows(df)


def test_parts_in_source_order(spark, tmp_path):
    text = "k,t\n" + "".join(f"{(i * 37) % 2500},x\n" for i in range(2500))
    (tmp_path / "in.csv").write_text(text)
    df = csv.load_positional(spark, str(tmp_path / "in.csv"), spark.range(1).selectExpr("int(1) k", "'' t").schema)
    parts = split.split_parts(df).orderBy("part", "row_in_part").collect()
    assert [r["k"] for r in parts] == [(i * 37) % 2500 for i in range(2500)]


def test_snapshots(spark, tmp_path):
    table = str(tmp_path / "t")
    assert store.read_version(spark, table) is None
    assert store.publish(spark.range(3), table).endswith("version=000000000000")
    current = store.read_version(spark, table)
    store.publish(current.filter("id > 0"), table)
    store.publish(spark.range(100), table, 1)
    assert store.versions(spark, table) == [0, 1]
    assert rows(store.read_version(spark, table)) == [(1,), (2,)]
    assert store.read_version(spark, table, before=1).count() == 3


def test_failed_publish_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    store.publish(spark.range(3), table)
    broken = spark.range(10).withColumn(
        "id", F.when(F.col("id") == 9, F.raise_error(F.lit("bad row"))).otherwise(F.col("id"))
    )
    with pytest.raises(Exception, match="bad row"):
        store.publish(broken, table)
    assert store.read_version(spark, table).count() == 3
    store.publish(spark.range(5), table)
    assert store.read_version(spark, table).count() == 5


def test_cross_distribution(spark):
    values = [("a" if i % 2 else None, i % 50 if i % 3 else 7, "other" if i % 5 else "x") for i in range(600)]
    df = spark.createDataFrame(values, "a string, b int, c string")
    found = stats.cross_distribution(df, ["a", "b", "c"], [1, 2, 3], top=3).collect()
    sums = {}
    for r in found:
        sums[r["dimensions"]] = sums.get(r["dimensions"], 0) + r["share"]
    assert set(sums) == {"a", "b", "c", "a,b", "a,c", "b,c", "a,b,c"}
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    by = {(r["dimensions"], r["a"], r["a_is"], r["b"], r["b_is"], r["c"], r["c_is"]): r["n"] for r in found}
    assert by["b", None, "all", "7", "value", None, "all"] == sum(v[1] == 7 for v in values)
    top = {7} | {int(k[3]) for k in by if k[0] == "b" and k[4] == "value"}
    assert len(top) == 3
    assert by["a,b", None, "null", None, "other", None, "all"] == sum(v[0] is None and v[1] not in top for v in values)
    assert by["a,b,c", "a", "value", "7", "value", "other", "value"] == sum(v == ("a", 7, "other") for v in values)
    assert len(by) == len(found)
    assert stats.cross_distribution(df.limit(0), ["a", "b"]).collect() == []
    with pytest.raises(ValueError, match="no sets"):
        stats.cross_distribution(df, ["a"], 2)
