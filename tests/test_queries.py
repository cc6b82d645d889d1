"""Every core query with SQL agrees with DuckDB; the others give rows, and the same ones again."""

import pytest

from mixloom.plans import catalogue
from tests import oracle

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, sf, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_the_same_rows_again(spark, sf, name):
    once, again = (sorted(map(repr, QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert once and once == again


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
