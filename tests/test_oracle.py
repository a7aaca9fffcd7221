"""Every registered query with equal SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import checks
from compare import compare, connect

D = "/root/testdata/sf0.001"
ORACLE = checks.ORACLE


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, con, name):
    compare(spark, con, name, checks.QUERIES[name], ORACLE.get(name), D)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_everything_has_sql():
    assert set(checks.QUERIES) == set(ORACLE)
    assert set(checks.QUERIES) <= set(entry.queries())
