"""Queries that SQL can express, against their SQL, on whole results."""

from __future__ import annotations

import pytest
from compare import connect, differences

from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name, scale):
    path = f"/root/testdata/{scale}"
    with connect(path) as connection:
        assert differences(QUERIES[name](spark, path), connection, SQL[name]) == []
