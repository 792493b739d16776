"""Every registered query against DuckDB on the same tables."""

import pytest
from oracle_check import compare, connect

from evalmill.plans.catalog import QUERIES
from evalmill.plans.oracle import ORACLE
from __spark_entry__ import entry, oracle_sql, queries

SCALES = ["sf0.001", "sf0.01"]


@pytest.fixture(scope="module", params=SCALES)
def tables(request):
    sf_dir = f"/root/testdata/{request.param}"
    con = connect(sf_dir)
    yield sf_dir, con
    con.close()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, tables, name):
    sf_dir, con = tables
    assert compare(queries()[name](spark, sf_dir), con, oracle_sql()[name]) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["subject", "correct", "total", "accuracy"]
    assert result.count() > 0
