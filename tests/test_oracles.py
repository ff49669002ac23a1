"""Every query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from workload.compare import differences, duckdb_on
from workload.oracles import oracle_sql
from workload.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duckdb_on(SF)


def test_every_query_has_a_check():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    df = queries()[name](spark, SF)
    assert differences(df, connection, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
