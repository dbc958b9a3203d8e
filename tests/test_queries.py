"""Every registered query against its SQL on the smallest supplied tables."""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")


@pytest.fixture(scope="module")
def db():
    return duck(SF_DIR)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, db, name):
    assert difference(entry.queries()[name](spark, SF_DIR), db, entry.oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    scores = [r["dependency_score"] for r in rows]
    assert rows and scores == sorted(scores, reverse=True)
