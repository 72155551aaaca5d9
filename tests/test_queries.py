"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from loomstone import plans
from loomstone.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in plans.ORACLES:
        assert got
        return
    sql.execute(plans.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=str)
