"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
from tests import twins
from wattledger.plans import catalog

QUERIES, SQL = catalog.QUERIES, catalog.SQL_TWINS


@pytest.fixture(scope="module")
def db(small):
    return twins.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    got = twins.rows_of_spark(QUERIES[name](spark, small))
    assert got[1]
    if name in SQL:
        assert twins.difference(got, twins.rows_of_sql(db, SQL[name])) is None


def test_entry(spark, small):
    assert contract.entry(spark).columns[:2] == ["device_id", "base_day"]


def test_no_twin_without_query():
    assert set(SQL) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
