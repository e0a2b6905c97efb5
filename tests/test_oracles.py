"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from tempora.plans import registry
from tempora.sources.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, bool) or not isinstance(x, int):
        return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)
    return f"{float(x):.6g}" if abs(x) < 1e6 else str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in rows])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = table(got.columns, [tuple(r) for r in got.collect()])
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows == table(names, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
