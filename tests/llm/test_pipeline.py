from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rollbook.llm.tables import stage

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, docs):
    columns, kept = docs.columns, {r["doc_id"] for r in docs.collect()}
    table = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        table = stage(function(spark, table, SF), "test")
        assert table.columns == columns, name
        ids = [r["doc_id"] for r in table.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept
        kept = set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF)
    assert {r["doc_id"] for r in last.collect()} == kept
    assert 0 < len(kept) < docs.count()
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(r["ids_sha256"] for r in whole.collect()) == Counter(r["ids_sha256"] for r in last.collect())


@pytest.mark.parametrize("stage_at", range(5))
def test_odd_rows(spark, odd, nothing, stage_at):
    _, function = corpus_pipeline.STAGES[stage_at]
    out = function(spark, odd, SF)
    if stage_at < 4:
        assert out.schema == odd.schema
    assert out.where(F.col("doc_id") == 2).count() <= 1
    assert function(spark, nothing, SF).collect() == []
