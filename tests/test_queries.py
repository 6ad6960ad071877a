"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from textloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents events pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda x: sorted(map(repr, x[columns].astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
