"""Every named query with an SQL twin agrees with it; the others give rows."""

import pytest
from oracle import compare, duck

from tidemark.plans import QUERIES, SQL

SLOW = {"model_search", "cluster_search", "retrained_model", "learning_curve", "validation_curve", "best_trials"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
