"""Every query with an SQL counterpart gives the same rows, and some, at a size where no input is empty."""

import pytest

import __spark_entry__ as entry
from cohortry.catalog import ORACLES, QUERIES
from tests.check import compare, connect

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_counterparts_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_counterpart(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok and not note.endswith("empty"), note
