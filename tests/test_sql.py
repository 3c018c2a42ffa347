"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import difference
from workloads import classification, messages, readback, stores, texts

FOLDER = "/root/testdata/sf0.001"


def test_every_mail_query_has_sql():
    assert {name for module in (texts, messages, classification, stores, readback) for name in module.QUERIES} <= set(entry.oracle_sql())


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    assert difference(entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name], FOLDER) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
