"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

from panelwright.plans import load_all, registry

load_all()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    assert got
    if name in registry.ORACLE_SQL:
        r = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert got == ordered([tuple(plain(row[i]) for i in at) for row in r.fetchall()])
