"""Every catalogue query against its SQL, on the smallest folder."""

import pytest

from babelgauge.catalog import oracle_sql, queries
from tests.compare import ROOT, check, database

QUERIES, SQL = queries(), oracle_sql()
FOLDER = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("key", QUERIES)
def test_matches_sql(spark, con, key):
    problem, _, _, n = check(spark, con, FOLDER, key, QUERIES[key], SQL.get(key))
    assert problem is None
    assert n > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)
