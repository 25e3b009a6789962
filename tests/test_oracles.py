"""Every registered query of the core library runs; those with an oracle give its rows."""

import pytest
from lexiquarry.plans import registry

import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, con, name):
    assert oracle.difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1
