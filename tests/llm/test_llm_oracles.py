"""Training-data queries that SQL can express, against their SQL."""

import pytest
from lexiquarry.llm import queries

import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, name):
    assert oracle.difference(spark, oracle.connection(), queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""
