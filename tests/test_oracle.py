"""Every registered query against its SQL (or, without SQL, that it gives rows)."""

import pytest
from oracle import check, connect

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf, con, name):
    ok, note = check(spark, con, sf, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note
