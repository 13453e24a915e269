"""Every registered query of the directory runs on the driver's tables and gives its SQL's rows."""

from __future__ import annotations

import pytest

from tests.oracle import connect, spark_rows, sql_rows
from waymark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert (columns, rows) == sql_rows(con, ORACLES[name])
    else:
        assert columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
