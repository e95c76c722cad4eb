import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import trim_all
from rollbook.sources import store
from rollbook.streaming import ingest, ingest_dir

SCHEMA = T.StructType(
    [T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("keep", T.StringType())]
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def take(spark, folder, **options):
    return ingest_dir(
        spark,
        str(folder / "in"),
        SCHEMA,
        ["k"],
        ["v"],
        str(folder / "table"),
        str(folder / "log"),
        **options,
    )


def test_files_are_merged_once(spark, folder):
    (folder / "in" / "1.csv").write_text('k,v,keep\n1,a,x\n1,b,y\n2,"",\n')
    assert rows(take(spark, folder)) == [(1, "a", "x"), (2, "", None)]
    (folder / "in" / "2.csv").write_text("k,v,keep\n2,z,new\n3,c,d\n")
    after = [(1, "a", "x"), (2, "z", None), (3, "c", "d")]
    assert rows(take(spark, folder)) == after
    assert rows(take(spark, folder)) == after


def test_a_repeated_batch_changes_nothing(spark, folder, tmp_path_factory):
    (folder / "in" / "1.csv").write_text("k,v,keep\n1,a,x\n")
    first = rows(take(spark, folder))
    # The log is lost, so the first batch runs again under its old number.
    again = ingest_dir(
        spark,
        str(folder / "in"),
        SCHEMA,
        ["k"],
        ["v"],
        str(folder / "table"),
        str(tmp_path_factory.mktemp("log")),
    )
    assert rows(again) == first


def test_many_batches_with_normalising(spark, folder):
    for number in range(4):
        (folder / "in" / f"{number}.csv").write_text(f"k,v,keep\n1, {number} ,x\n{number + 2},n,y\n")
    table = take(
        spark, folder, files_per_batch=1, normalise=lambda df: trim_all(df, ["v"])
    )
    assert rows(table, "k") == [(k,) for k in range(1, 6)]
    assert table.filter("k = 1").select(F.length("v")).first()[0] == 1


def test_a_bad_file_fails_and_leaves_the_table(spark, folder):
    (folder / "in" / "1.csv").write_text("k,v,keep\n1,a,x\n")
    take(spark, folder)
    (folder / "in" / "2.csv").write_text("k,v,keep\n1,a\n")
    with pytest.raises(Exception, match="MALFORMED"):
        take(spark, folder)
    assert rows(store.read_ranges(spark, str(folder / "table"))) == [(1, "a", "x")]


def test_a_killed_batch_is_taken_again(spark, folder, monkeypatch):
    """The first try dies before its merge, the second after it."""
    (folder / "in" / "1.csv").write_text("k,v,keep\n1,a,x\n")
    take(spark, folder)
    (folder / "in" / "2.csv").write_text("k,v,keep\n1,b,y\n2,c,z\n")
    real = ingest.merge

    def killed_before(*args):
        raise RuntimeError("killed")

    def killed_after(*args):
        real(*args)
        raise RuntimeError("killed")

    for kill, known in ((killed_before, [(1, "a", "x")]), (killed_after, [(1, "b", "x"), (2, "c", "z")])):
        monkeypatch.setattr(ingest, "merge", kill)
        with pytest.raises(Exception, match="killed"):
            take(spark, folder)
        assert rows(store.read_ranges(spark, str(folder / "table"))) == known
    monkeypatch.undo()
    assert rows(take(spark, folder)) == [(1, "b", "x"), (2, "c", "z")]


def test_records_that_span_lines_and_open_quotes(spark, folder):
    (folder / "in" / "1.csv").write_bytes(b'k,v,keep\r\n1,"a\r\n""b""",x\r\n2,"",\r\n')
    assert rows(take(spark, folder)) == [(1, 'a\r\n"b"', "x"), (2, "", None)]
    (folder / "in" / "2.csv").write_text('k,v,keep\n3,"a,x\n4,b,y\n')
    with pytest.raises(Exception, match="unterminated"):
        take(spark, folder)
    assert store.read_ranges(spark, str(folder / "table")).count() == 2


def test_nothing_has_arrived(spark, folder):
    assert rows(take(spark, folder)) == []


def files_of(table):
    return {str(f) for f in table.rglob("*.parquet")}


def ranged(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"), F.lit("x").alias("keep"), F.lit(0).alias("o"))


def test_a_batch_of_one_range_rewrites_only_its_files(spark, tmp_path):
    table = tmp_path / "table"
    store.merge(ranged(spark, 500), str(table), ["k"], ["v"], ["o"], rows_per_range=60)
    before = files_of(table)
    assert len(before) >= 8
    late = ranged(spark, 12).withColumns({"k": F.col("k") + 200, "v": F.lit("z")})
    store.merge(late, str(table), ["k"], ["v"], ["o"], rows_per_range=60)
    after = files_of(table)
    assert 1 <= len(before - after) <= 2 and len(after - before) == len(before - after)
    now = store.read_ranges(spark, str(table))
    assert now.count() == 500 and now.filter("v = 'z'").count() == 12


def test_ranges_grow_and_are_cut(spark, tmp_path):
    table = str(tmp_path / "table")
    for start in (0, 1000, 300, -400):
        batch = ranged(spark, 400).withColumn("k", F.col("k") + start)
        store.merge(batch, table, ["k"], ["v"], ["o"], rows_per_range=100)
    now = spark.read.parquet(table).groupBy("_from").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    found = sorted((r["low"], r["high"], r["n"]) for r in now.collect())
    assert sum(n for _, _, n in found) == 1500 and max(n for _, _, n in found) <= 200
    assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_text_keys_keep_their_ranges(spark, tmp_path):
    table = str(tmp_path / "table")
    keys = ["", "007", "7", "a/b", "a=b", "é", "null", "__HIVE", "x y", "%41"] + [f"{i:03d}" for i in range(40)]
    batch = spark.createDataFrame([(k, k) for k in keys], "id string, v string").withColumn("o", F.lit(1))
    store.merge(batch, table, ["id"], ["v"], ["o"], rows_per_range=5)
    store.merge(batch.withColumn("v", F.lit("new")), table, ["id"], ["v"], ["o"], rows_per_range=5)
    assert rows(store.read_ranges(spark, table)) == sorted([(k, "new") for k in set(keys)], key=str)


def test_two_keys_and_a_bad_batch(spark, tmp_path):
    table = str(tmp_path / "table")
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "k int, y string, v int").withColumn("o", F.lit(1))
    store.merge(batch, table, ["k", "y"], ["v"], ["o"])
    bad = batch.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("bad row")).cast("int")).otherwise(9))
    with pytest.raises(Exception, match="bad row"):
        store.merge(bad, table, ["k", "y"], ["v"], ["o"])
    assert rows(store.read_ranges(spark, table)) == [(1, "a", 1), (1, "b", 2), (2, "a", 3)]
    with pytest.raises(ValueError, match="no key ranges"):
        store.merge(batch.withColumn("k", F.lit(1.5)), table, ["k"], ["v"], ["o"])


def test_range_of_finds_the_bound_below(spark):
    bounds = list(range(0, 500, 7))
    df = spark.range(-3, 520).withColumn("b", store.range_of(F.col("id"), [None, *bounds], T.LongType()))
    assert all(r["b"] == max([b for b in bounds if b <= r["id"]], default=None) for r in df.collect())
