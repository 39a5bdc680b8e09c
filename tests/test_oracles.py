"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidemark.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(x):
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, (int, float, np.number)) or type(x).__name__ == "Decimal" else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, str(DATA))
    got = df.collect()
    if name not in catalogue.oracle_sql():
        assert got
        return
    found = duck.execute(catalogue.oracle_sql()[name])
    want = found.fetchall()
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want)
