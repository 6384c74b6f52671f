"""Every registered query against its SQL in another engine, on the smallest data."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from workload.registry import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_its_check():
    assert set(ORACLE) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_result(spark, db, name):
    # two empty results prove nothing
    assert compare(queries()[name](spark, SF_DIR), db, oracle_sql()[name]) is None


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["row_id", "rule_id", "violated_column"]
    assert found.count() > 0
