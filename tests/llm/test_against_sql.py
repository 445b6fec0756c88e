"""Corpus queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from tallyforge.llm import queries
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF).toPandas(), duck(SF).sql(queries.ORACLES[name]).df())
