import os
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollbook.llm import mixing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import database, rows_of_sql  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_rows_equal_sql(spark, docs):
    names, want = rows_of_sql(database(SF), mixing.oracle_sql())
    out = mixing.mixed(docs)
    got = out.select(*names).collect()
    assert sorted(out.columns) == names
    key = names.index("doc_id")
    by_id = {r[key][1]: r for r in want}
    for r in got:
        for value, (_, other) in zip(r, by_id[str(r["doc_id"])] if str(r["doc_id"]) in by_id else by_id[r["doc_id"]], strict=True):
            assert value == (float(other) if isinstance(value, float) else other)


def test_marginals_are_met(docs):
    rows = mixing.weighted(docs)
    total = rows.agg(F.sum("__tokens")).first()[0]
    for d in mixing.DIMENSIONS:
        own = rows.groupBy(f"__{d}").agg(F.sum("__tokens").alias("t"), F.sum(F.col("__tokens") * F.col("__weight")).alias("w")).collect()
        raw = sum(r["t"] ** mixing.TEMPER for r in own)
        for r in own:
            assert r["w"] / total == pytest.approx(r["t"] ** mixing.TEMPER / raw, abs=0.02)


def test_expected_tokens_are_the_share(docs):
    rows = mixing.weighted(docs, share=0.4)
    t, e, k = rows.agg(F.sum("__tokens"), F.sum(F.col("__tokens") * F.col("__probability")), F.sum(F.when(F.col("__kept"), F.col("__tokens")))).first()
    assert e / t == pytest.approx(0.4, abs=0.001)
    assert k / t == pytest.approx(0.4, abs=0.12)


def _shares(rows, dimension):
    """Tokens, expected tokens and kept tokens of each value, as shares of their sums."""
    kept = F.when(F.col("__kept"), F.col("__tokens")).otherwise(0)
    own = rows.groupBy(f"__{dimension}").agg(F.sum("__tokens"), F.sum(F.col("__tokens") * F.col("__probability")), F.sum(kept)).collect()
    sums = [sum(r[i] for r in own) for i in (1, 2, 3)]
    return {r[0]: tuple(r[i] / sums[i - 1] for i in (1, 2, 3)) for r in own}


def test_kept_rows_have_the_target_shares(spark):
    """Targets that a sample of 60 % can reach, but not by cutting the weights at 1."""
    rows = [(i, "w " * 10, f"s{i % 4}", ("x", "y", "y", "z", "z")[i % 5], f"t{i % 3 if i % 7 else 0}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, form string")
    targets = {"lang": {"x": 0.3, "y": 0.3, "z": 0.4}, "source": {"s0": 0.35, "s1": 0.25, "s2": 0.2, "s3": 0.2}, "topic": {"t0": 0.3, "t1": 0.38, "t2": 0.32}}
    out = mixing.weighted(df, topic="form", targets=targets, share=0.6)
    for d, wanted in targets.items():
        for value, (_, expected, kept) in _shares(out, d).items():
            assert expected == pytest.approx(wanted[value], abs=0.005)
            assert kept == pytest.approx(wanted[value], abs=0.02)


def _goals(own):
    """The shares that a sample of ``SHARE`` of all tokens can have: targets, or all there is, the others being scaled alike."""
    raw = sum(t**mixing.TEMPER for t in own.values())
    most = {v: min(1.0, t / mixing.SHARE) for v, t in own.items()}
    short = {v for v in own if own[v] ** mixing.TEMPER / raw > most[v]}
    scale = 1.0  # of the targets of the others
    while True:
        goal = {v: most[v] if v in short else scale * own[v] ** mixing.TEMPER / raw for v in own}
        over = {v for v in own if goal[v] > most[v]}
        if not over and abs(sum(goal.values()) - 1) < 1e-9:
            return goal
        short |= over
        scale = (1 - sum(most[v] for v in short)) / sum(own[v] ** mixing.TEMPER / raw for v in own if v not in short)


def test_a_target_out_of_reach_takes_all_there_is(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.weighted(big)
    for d in mixing.DIMENSIONS:
        own = _shares(out, d)
        goal = _goals({v: t for v, (t, _, _) in own.items()})
        for v, (_, expected, _) in own.items():
            assert expected == pytest.approx(goal[v], abs=0.01)


def test_the_query_is_calibrated(spark):
    """Expected tokens of what ``mixed`` keeps have the shares that can be had, in all dimensions."""
    rows = mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    total, expected = rows.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability"))).first()
    assert expected == pytest.approx(mixing.SHARE * total, rel=1e-4)
    for d in mixing.DIMENSIONS:
        own = {r[0]: (r[1] / total, r[2] / expected) for r in rows.groupBy(d).agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability"))).collect()}
        goal = _goals({v: t for v, (t, _) in own.items()})
        for v, (_, share) in own.items():
            assert share == pytest.approx(goal[v], abs=0.01)


def test_given_targets(spark):
    rows = [(i, "w " * 10, "a" if i % 3 else "b", "x" if i % 2 else "y", 20) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = mixing.weighted(df, topic="lang", targets={"source": {"a": 1.0, "b": 3.0, "other": 5.0}, "lang": {"x": 1.0}, "topic": {"x": 1.0}})
    share = {r[0]: r[1] for r in out.groupBy("__source").agg(F.sum(F.col("__tokens") * F.col("__weight"))).collect()}
    assert share["b"] == pytest.approx(3 * share["a"], rel=1e-6)
    assert out.where("__lang = 'y' and __kept").count() == 0


def test_a_row_is_sampled_alike_each_time(docs):
    a, b = (sorted(r[0] for r in mixing.sampled(docs.repartition(n)).select("doc_id").collect()) for n in (2, 9))
    assert a == b


def test_no_python_in_the_plan(docs):
    plan = mixing.weighted(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(odd, odd_rows, nothing):
    got = mixing.mixed(odd).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in odd_rows)
    assert mixing.sampled(odd).schema == odd.schema
    assert mixing.mixed(nothing).collect() == []
    assert mixing.sampled(nothing).collect() == []
