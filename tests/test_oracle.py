import os

import pytest
from oracle import DATA, same, views

from textquarry.plans import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, DATA), SQL[name], views())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0
