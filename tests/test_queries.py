import os

import pytest

import __spark_entry__ as entry
from tests.oracle import SMALL, connect, same
from utterlake.plans import corpus_queries, interval_queries, source_queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
WITH_SQL = corpus_queries.SQL | interval_queries.SQL | source_queries.SQL
ALL = corpus_queries.QUERIES | interval_queries.QUERIES | source_queries.QUERIES


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(WITH_SQL))
def test_query_equals_sql(spark, con, name):
    same(spark, con, ALL[name], WITH_SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(WITH_SQL)))
def test_query_runs(spark, name):
    assert ALL[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
