"""Every query of the library that has SQL, against DuckDB on the smallest tables."""

import oracle
import pytest

from telemill.plans import registry
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in registry.QUERIES if n in registry.ORACLES)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert oracle.difference(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
