"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest
from compare import compare, connect

from bytesieve.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    fn = catalog.queries()[name]
    if name not in ORACLES:
        assert fn(spark, SF).count() > 0
        return
    message, *_ = compare(spark, con, name, fn, ORACLES[name], SF)
    assert not message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
