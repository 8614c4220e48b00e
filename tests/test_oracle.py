"""Every registered query against its oracle on the smallest driver tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")

from codeharbor.catalog import all_oracles, all_queries  # noqa: E402
from tools.check import TABLES, table  # noqa: E402


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, database, name):
    frame = all_queries()[name](spark, SF)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    if name in all_oracles():
        result = database.execute(all_oracles()[name])
        assert got == table([d[0] for d in result.description], result.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
