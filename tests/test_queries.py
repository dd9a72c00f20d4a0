"""Every registered query runs; those with SQL must equal it row for row."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck_con, name):
    diff, n = differences(QUERIES[name](spark, sf_dir), duck_con, ORACLES[name])
    assert not diff and n > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect()
