"""Every query against its SQL."""

import os

import pytest

from tests.compare import DATA, connect, differ
from textmill.plans import oracles, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    if name in oracles.oracle_sql():
        assert differ(df, con, oracles.oracle_sql()[name]) == ""
    else:
        assert df.count() > 0
