"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import pytest
from oracle import database, differences

import __spark_entry__ as entry
from evenkeel.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_the_driver_sees_them_all():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "action", "changed_cols"]
    assert {r.action for r in df.select("action").distinct().collect()} == {"CREATE", "UPDATE", "NOOP"}
