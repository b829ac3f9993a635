"""Corpus queries with SQL against DuckDB on the smallest tables."""

import os

import pytest
from oracle import both, connect

from wayframe.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    mine, theirs = both(spark, connect(DATA), QUERIES[name], ORACLE_SQL[name], DATA)
    assert mine == theirs
