import os

import pytest
from oracle import DATA

import __spark_entry__
from textquarry.plans import queries


def test_without_the_optional_operators(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name: None)
    assert set(__spark_entry__.queries()) == set(queries.queries()) and set(__spark_entry__.oracle_sql()) == set(queries.oracle_sql())


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
