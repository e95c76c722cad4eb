"""Every registered query against SQL on the same tables."""

import os

import pytest
from compare import database, rows_of, rows_of_sql, types_of, types_of_sql

from rollbook.oracle import ORACLE
from rollbook.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    return database(SF)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, tables, name):
    result = QUERIES[name](spark, SF)
    assert types_of(result) == types_of_sql(tables, ORACLE[name])
    assert rows_of(result) == rows_of_sql(tables, ORACLE[name])


def test_a_large_request_table_is_asked(spark):
    """Every line item asks, about half of them for users that don't exist."""
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    rows = QUERIES["codes_of_requested"](spark, SF)
    by = {r[0]: r[1] for r in rows.groupBy("nama").count().collect()}
    assert by["found"] + by["not_found"] == n
    assert 0.3 * n < by["found"] < 0.7 * n


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= entry.queries().keys()
    assert set(entry.oracle_sql()) <= entry.queries().keys()
