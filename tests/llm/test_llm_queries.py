import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import connection, same  # noqa: E402

from chatlore.llm import queries as Q  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(spark, small, con, name):
    same(spark, con, Q.QUERIES[name], Q.ORACLE[name], small)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(spark, small, name):
    rows = Q.QUERIES[name](spark, small)
    assert rows.count() == rows.distinct().count() if name.endswith("_found") else rows.count() >= 0
