"""Every query with a SQL counterpart gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from lodestone.plans import all_queries, all_sql
from lodestone.plans.queries import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    want = duck.sql(all_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
