"""Every registered query beside its SQL, on the smallest test tables."""
import os

import pytest

import __spark_entry__ as entry
from check_sql import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    fn = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF).count() >= 0
    else:
        assert compare(spark, duck, SF, name, fn, sql) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
