"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(contract.queries()))
def test_query_matches_sql(spark, con, key):
    ok, note = compare(spark, con, key, SF)
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).count() > 0
