"""Every registered query of the equity jobs against its DuckDB statement."""

import os

import duckdb
import pytest

from equity_jobs.plans import catalog
from equity_jobs.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {name} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert sorted((tuple(r) for r in frame.select(columns).collect()), key=str) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r.queue_rank for r in sorted(rows, key=lambda r: r.queue_rank)] == list(range(1, len(rows) + 1))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
