"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from factloom.suite import load

PATH = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["fy", "value", "basis"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, PATH, name, QUERIES[name], ORACLES.get(name))
    assert ok, message
