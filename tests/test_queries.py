import pytest
from oracle import assert_same

from tidemill.plans import extensions, queries

QUERIES, ORACLE_SQL = queries.QUERIES | extensions.QUERIES, queries.ORACLE_SQL | extensions.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
