from __future__ import annotations

import pytest
from oracle import SMALL, assert_same

from batchloom.plans import problems, reference

SQL = problems.SQL | reference.SQL
QUERIES = problems.QUERIES | reference.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert_same(spark, duck, QUERIES[name], SQL[name], SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
