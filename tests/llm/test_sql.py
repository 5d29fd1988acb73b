"""The training-data queries that SQL can express, against their SQL."""

import compare
import pytest

from stoa.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare.difference(spark, compare.duck(sf), queries.QUERIES[name], queries.ORACLES[name], sf) is None
