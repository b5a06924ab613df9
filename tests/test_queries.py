"""Every registered query next to its SQL."""

import pytest
from tests.conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF, QUERIES[name], SQL.get(name))
    assert result.startswith(("ok", "ROWS")), result


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0
