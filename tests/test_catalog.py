"""Every query with SQL against DuckDB; the driver contract."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark import catalog


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return x.isoformat() if isinstance(x, (datetime.datetime, datetime.date)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in catalog.ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert sorted(tuple(map(plain, (r[c] for c in columns))) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
