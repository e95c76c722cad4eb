import random

import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F

from rollbook.functions import grams
from rollbook.functions.predicates import ilike_pattern, search
from rollbook.operators.search import _bitmaps, pattern_column, search_batch

TEXTS = ["", "%", "_", "a", "ab", "an", "An%A", "a_a", "ana", "xyz", "50%", "50\\%", "a\\b", "\\_", " an ", "é", "ÉL", "日本", "a%b%c", "nan", "____", "banana", "b%", "\\\\", "x\\", "'", "\n"]
VALUES = ["", "banana", "BANANA split", "an", "a", "50% off", "50 off", "a_a", "aXa", "ab", "a\\b", "élan", "ÉLAN", "日本語", "日", None, "a-b-c", "\\", "x%", "_", "new\nline", "it's"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, v, VALUES[-1 - i]) for i, v in enumerate(VALUES)], "id int, a string, b string").repartition(3)


@pytest.mark.parametrize("literal", [False, True])
def test_a_batch_finds_what_single_searches_find(spark, table, literal):
    terms = [("a", "contains"), ("b", "contains")]
    asked = spark.createDataFrame([(i, q) for i, q in enumerate([*TEXTS, "an", None])], "request_id int, q string")
    found = search_batch(table, asked, terms, "id", literal=literal)
    expected = []
    for i, q in enumerate([*TEXTS, "an"]):
        expected += [(i, r["id"]) for r in search(table, terms, q, literal=literal).select("id").collect()]
    assert rows(found) == sorted(expected, key=str)


def test_exact_and_trimmed(spark, table):
    texts = [q for q in TEXTS if q != "x\\"]
    asked = spark.createDataFrame(list(enumerate([f"\t{q} " for q in texts])), "request_id int, q string")
    found = search_batch(table, asked, [("a", "exact")], "id", trim=True)
    expected = []
    for i, q in enumerate(texts):
        expected += [(i, r["id"]) for r in search(table, [("a", "exact")], q, trim=True).select("id").collect()]
    assert rows(found) == sorted(expected, key=str)
    lone = spark.createDataFrame([(1, "x\\")], "request_id int, q string")
    with pytest.raises(Exception, match="must not end with a backslash"):
        search_batch(table, lone, [("a", "exact")], "id").collect()


def test_pattern_column(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a%_\\b") for _ in range(rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    for literal in (False, True):
        got = {r[0]: r[1] for r in df.select("q", pattern_column(F.col("q"), "contains", literal)).collect()}
        assert got == {t: ilike_pattern(t, "contains", literal) for t in texts}


def test_no_product_in_the_plan(spark, table):
    asked = spark.createDataFrame([(1, "an")], "request_id int, q string")
    plan = search_batch(table, asked, [("a", "contains")], "id")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_nothing_asked_or_nothing_there(spark, table):
    asked = spark.createDataFrame([(1, "an")], "request_id int, q string")
    assert rows(search_batch(table, asked.limit(0), [("a", "contains")], "id")) == []
    assert rows(search_batch(table.limit(0), asked, [("a", "contains")], "id")) == []


def test_grams_in_blocks_of_texts(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé\0日😀?") for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(300)]
    asked = {"".join(rng.choice("abé\0日😀?") for _ in range(n)) for n in (1, 2, 3) for _ in range(12)} | {""}
    monkeypatch.setattr(grams, "_BLOCK", 100)
    bits = _bitmaps(spark.createDataFrame([(g,) for g in asked], "_gram string"))
    batch = pa.record_batch([pa.array(range(300)), pa.array(texts)], ["_key", "_text"])
    found = [(r["_key"], r["_gram"]) for b in grams.finder(bits, [0, 1, 2, 3])([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert len(found) == len(set(found))
    held = {(i, t[at : at + n]) for i, t in enumerate(texts) for n in (0, 1, 2, 3) for at in range(len(t) - n + 1)}
    assert {f for f in found if f[1] in asked} == {h for h in held if h[1] in asked}
    assert set(found) <= held


def test_characters_beyond_16_bits(spark):
    """A character of two UTF-16 units is one; its second half is no question mark."""
    table = spark.createDataFrame([(1, "😀ab"), (2, "?ab")], "id int, a string")
    asked = spark.createDataFrame([(1, "?ab"), (2, "😀ab"), (3, "?a"), (4, "😀")], "request_id int, q string")
    found = search_batch(table, asked, [("a", "contains")], "id")
    assert rows(found) == [(1, 2), (2, 1), (3, 2), (4, 1)]


def test_patterns_travel_to_their_postings(spark, table):
    asked = spark.createDataFrame([(1, "an"), (2, "anana")], "request_id int, q string")
    plan = search_batch(table, asked, [("a", "contains")], "id")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_gram" in line and "Inner" in line]
    assert len(joins) == 2 and all("broadcast" in line for line in joins)
