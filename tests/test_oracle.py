"""Every registered query against its oracle on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        rows, problems = compare(spark, con, SF, QUERIES[name], ORACLE[name])
        assert not problems, problems
    else:
        QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
