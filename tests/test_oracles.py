"""Every core query with SQL against that SQL, on the smallest tables."""

import pytest

from vecstrand.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_sql_only_for_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
