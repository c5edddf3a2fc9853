"""Every registered query against its SQL, and the entry points."""

import pytest

import __spark_entry__ as entry_points
from postweave.plans import all_queries
from tests.compare import compare, connect
from tests.conftest import SMALL

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    message, rows = compare(spark, con, QUERIES[name], SMALL)
    assert not message
    assert rows > 0


def test_entry_points_agree(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).columns == ["label", "n"]
