"""Every registered query against its SQL, on the smallest test tables."""

import os

import pytest
from oracle import compare, folder

import __spark_entry__ as entry

needs_data = pytest.mark.skipif(not os.path.isdir(folder("0.001")), reason="test tables not present")


@needs_data
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    ok, note = compare(spark, name, folder("0.001"))
    assert ok, note


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
