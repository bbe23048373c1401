"""Every registered query next to its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    verdict, _, _, _ = compare(spark, duck, SF, name)
    assert verdict in ("ok", "no sql"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 14
