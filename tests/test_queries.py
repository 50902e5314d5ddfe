"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as registry
from newsloom.plans.oracles import ORACLES
from newsloom.plans.queries import QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(con, registry.queries()[name](spark, SF), registry.oracle_sql()[name]) == []


def test_entry(spark):
    assert registry.entry(spark).count() == 50
