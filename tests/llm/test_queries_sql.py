"""The pN_ queries with SQL agree with DuckDB."""

import pytest

from mixloom.llm.queries import QUERIES, SQL
from tests import oracle


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, name):
    assert oracle.compare(spark, oracle.connect(sf), sf, QUERIES[name], SQL[name]) is None
