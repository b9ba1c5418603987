"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    good, text = compare(spark, connection, name, queries()[name], oracle_sql().get(name), FOLDER)
    assert good, text


def test_entry(spark):
    assert entry(spark).count() > 0
