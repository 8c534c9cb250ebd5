"""Registered queries against their SQL on the smallest test tables.

Queries over price files are compared by ``check.py`` and have tests of their
own with hand-written files.
"""

import os

import pytest

import __spark_entry__ as entry
import check
import oracle
import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = ("ingest", "explicit", "overridden", "files_without", "stored", "quarantined", "streamed", "colliding", "unreadable")
NAMES = [n for n in registry.QUERIES if not n.startswith(SLOW)]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert check.compare(df, FOLDER, sql) == ""


def test_all_queries_have_sql():
    assert set(registry.QUERIES) == set(oracle.sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "facility_id"
