from __future__ import annotations

import pytest
from check import compare, duck

import __spark_entry__ as entry
from dnslens.plans import queries

SF = "/root/testdata/sf0.001"
QUERIES = queries.registered()
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert ok, note
    assert "types" not in note


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
