import pytest
from oracle import connection, same

from chatlore import archive_queries, problem_queries

QUERIES = archive_queries.QUERIES | problem_queries.QUERIES
ORACLE = archive_queries.ORACLE | problem_queries.ORACLE


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, small, con, name):
    same(spark, con, QUERIES[name], ORACLE[name], small)


def test_queries_without_sql_run(spark, small):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        rows = QUERIES[name](spark, small)
        assert rows.columns and rows.count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["zgram_id"]
    assert set(e.oracle_sql()) <= set(e.queries())
