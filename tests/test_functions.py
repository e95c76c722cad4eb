import datetime
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from rollbook.functions.predicates import eq_ci, ilike_pattern, search
from rollbook.functions.text import (
    blank_nulls,
    header_column,
    header_name,
    is_given,
    js_trim,
    normalize_header,
    or_default,
    trim_all,
)
from rollbook.functions.typed import (
    exact_int,
    leading_int,
    leading_int_of,
    leading_number,
    mixed_date,
    strict_int,
)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def apply(spark, values, expression):
    df = column(spark, values).select("i", expression(F.col("c")).alias("o"))
    return [r["o"] for r in sorted(df.collect(), key=lambda r: r["i"])]


DATES = {
    "45292": datetime.date(2024, 1, 1),
    " 45292 ": datetime.date(2024, 1, 1),
    "2024": datetime.date(1905, 7, 16),
    "0": datetime.date(1899, 12, 30),
    "2024-03-05": datetime.date(2024, 3, 5),
    "": None,
    "   ": None,
    None: None,
    "05/03/2024": None,
    "2024-3-5": None,
    "45292\n": None,
    "\t45292": None,
}


def test_mixed_date(spark):
    assert apply(spark, list(DATES), mixed_date) == list(DATES.values())


def test_mixed_date_min_serial(spark):
    values = ["2024", "45292", "2024-01-02"]
    result = apply(spark, values, lambda c: mixed_date(c, min_serial=10_000))
    assert result == [None, datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]


@pytest.mark.parametrize("text", ["2024-02-30", "99999999999"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_mixed_date_strict(spark, conf, text, ansi):
    conf(ansi__enabled=ansi)
    with pytest.raises(Exception, match="not a valid"):
        apply(spark, [text], mixed_date)
    assert apply(spark, [text], lambda c: mixed_date(c, strict=False)) == [None]


def test_strict_int(spark):
    values = [" 12 ", "", "   ", None, "-3", "+4"]
    assert apply(spark, values, strict_int) == [12, None, None, None, -3, 4]


@pytest.mark.parametrize("text", ["12x", "99999999999", "1.5", "\t"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_int_fails(spark, conf, text, ansi):
    conf(ansi__enabled=ansi)
    with pytest.raises(Exception, match="not a valid integer"):
        apply(spark, [text], strict_int)
    assert apply(spark, [text], lambda c: strict_int(c, strict=False)) == [None]


def test_exact_int(spark):
    assert apply(spark, ["7", None, " 8 "], exact_int) == [7, None, 8]
    with pytest.raises(Exception, match="not a valid integer"):
        apply(spark, [""], exact_int)


def test_leading_int(spark):
    values = ["12abc", "  7", " 8", "x1", "", None, "-5.9", "+3", "99999999999"]
    expected = [12, 7, 8, None, None, None, -5, 3, 99999999999]
    assert apply(spark, values, leading_int) == expected
    assert [leading_int_of(v) for v in values] == expected
    assert apply(spark, ["9" * 30], leading_number) == [1e30]


def test_trims(spark):
    messy = "﻿  \tx y\r\n"
    assert apply(spark, [messy, None], js_trim) == ["x y", None]
    assert apply(spark, ["  a\t ", "b "], F.trim) == ["a\t", "b"]
    df = trim_all(spark.createDataFrame([(" a ", " b ")], "p string, q string"), ["p"])
    assert rows(df) == [("a", " b ")]


def test_defaults(spark):
    values = [None, "", " ", "x"]
    assert apply(spark, values, lambda c: or_default(c, "d")) == ["d", "d", " ", "x"]
    assert apply(spark, values, is_given) == [False, False, True, True]
    df = spark.createDataFrame([(None, None), (1, "a")], "n int, t string")
    assert rows(blank_nulls(df)) == [("", ""), ("1", "a")]


HEADERS = {
    "raw": '﻿ "Nama  Sekolah" \r',
    "trim_lower": '"nama  sekolah"',
    "underscore": '_"nama_sekolah"_',
    "unquote": "nama  sekolah",
}


@pytest.mark.parametrize("rule", HEADERS)
def test_header_rules(spark, rule):
    raw = HEADERS["raw"]
    assert header_name(raw, rule) == HEADERS[rule]
    assert apply(spark, [raw], lambda c: header_column(c, rule)) == [HEADERS[rule]]


def test_header_of_frame(spark):
    df = normalize_header(spark.createDataFrame([(1, 2)], ["A B", " C"]), "underscore")
    assert df.columns == ["a_b", "_c"]
    with pytest.raises(ValueError, match="unknown header rule"):
        header_name("x", "other")


NAMES = ["Ring 5%", "r_ng", "ab", "", None, "a\\b"]


@pytest.mark.parametrize(
    ("q", "options", "found"),
    [
        ("", {}, ["", "Ring 5%", "a\\b", "ab", "r_ng"]),
        ("r_ng", {}, ["Ring 5%", "r_ng"]),
        ("r_ng", {"literal": True}, ["r_ng"]),
        ("%", {"literal": True}, ["Ring 5%"]),
        ("%", {}, ["", "Ring 5%", "a\\b", "ab", "r_ng"]),
        ("a\\b", {}, ["ab"]),
        ("a\\b", {"literal": True}, ["a\\b"]),
        ("5\\", {}, ["Ring 5%"]),
        (" ring ", {}, []),
        (" RING ", {"trim": True}, ["Ring 5%"]),
    ],
)
def test_search_contains(spark, q, options, found):
    df = spark.createDataFrame([(n,) for n in NAMES], "nama string")
    assert [r[0] for r in rows(search(df, [("nama", "contains")], q, **options))] == found


def test_search_exact(spark):
    df = spark.createDataFrame([("AB",), ("abc",), ("",), (None,)], "nama string")
    assert rows(search(df, [("nama", "exact")], "ab")) == [("AB",)]
    assert rows(search(df, [("nama", "exact")], "")) == [("",)]
    assert rows(search(df, [("nama", "exact")], "a%")) == [("AB",), ("abc",)]
    with pytest.raises(ValueError, match="backslash"):
        ilike_pattern("a\\", "exact")
    with pytest.raises(ValueError, match="unknown search mode"):
        ilike_pattern("a", "prefix")


def test_search_null_does_not_hide_a_hit(spark):
    df = spark.createDataFrame([(None, "x1"), ("x1", None), (None, None)], "a string, b string")
    assert search(df, [("a", "contains"), ("b", "exact")], "x1").count() == 2


def test_eq_ci(spark):
    df = spark.createDataFrame([("A", "a"), ("A", "b"), (None, "a")], "a string, b string")
    assert rows(df.filter(eq_ci(F.col("a"), F.col("b")))) == [("A", "a")]


def like(text: str, pattern: str) -> bool:
    """ILIKE by its definition, with a backslash that makes any next character literal."""
    if not pattern:
        return not text
    head, rest = pattern[0], pattern[1:]
    if head == "%":
        return any(like(text[i:], rest) for i in range(len(text) + 1))
    if head == "\\":
        head, rest = rest[0], rest[1:]
        return bool(text) and text[0].lower() == head.lower() and like(text[1:], rest)
    return bool(text) and (head == "_" or text[0].lower() == head.lower()) and like(text[1:], rest)


def test_search_text_means_what_the_database_makes_of_it(spark):
    """Random texts and searches over the characters with a meaning."""
    chance = random.Random(5)

    def some(longest):
        return "".join(chance.choice("aAb%_\\") for _ in range(chance.randint(0, longest)))

    cases = [(some(6), some(4)) for _ in range(300)]
    checks = [F.lit(t).ilike(ilike_pattern(q)) for t, q in cases]
    literal = [F.lit(t).ilike(ilike_pattern(q, literal=True)) for t, q in cases]
    found = spark.range(1).select(F.array(*checks), F.array(*literal)).first()
    assert list(found[0]) == [like(t, f"%{q}%") for t, q in cases]
    assert list(found[1]) == [q.lower() in t.lower() for t, q in cases]


@pytest.mark.parametrize("rule", HEADERS)
def test_header_rules_agree_on_any_text(spark, rule):
    chance = random.Random(7)
    alphabet = "aB\" \t\n\r ﻿　_"
    texts = ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 8))) for _ in range(200)]
    assert apply(spark, texts, lambda c: header_column(c, rule)) == [header_name(t, rule) for t in texts]
