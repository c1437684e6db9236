"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from folioworks.queries import ORACLE_SQL, QUERIES

from .compare import DATA, connect, difference

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLE_SQL[name], str(SF)) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
