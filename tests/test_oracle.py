"""Every query with SQL gives the same rows in DuckDB."""

import pytest
from compare import connect, difference
from sample import SF_DIR

import __spark_entry__ as driver

SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, db, name):
    df = driver.queries()[name](spark, SF_DIR)
    if name in SQL:
        assert difference(df, SQL[name], db) is None
    else:
        assert not df.isEmpty()


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 4 and sum(r["customers"] for r in rows) > 0
