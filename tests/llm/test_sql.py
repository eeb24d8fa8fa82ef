"""The queries that SQL can express, on the given tables."""

import pytest

from tessera.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])
