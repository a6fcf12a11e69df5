"""Every registered query at the smallest scale against its checking SQL."""

import pytest

import __spark_entry__ as entry
from parity import compare, connect
from trendloom.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    rows, _, problem = compare(spark, con, name, SF)
    assert not problem and rows > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "tech_grouped", "n", "share"] and df.count() > 0
