"""Every registered query against its check SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    rows, verdict = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert verdict in ("ok", "rows-only"), verdict
    assert rows > 0


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
