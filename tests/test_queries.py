"""Every registered query of the library's own operators runs, and agrees with its SQL on a second engine."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone import queries as own


@pytest.fixture(scope="module")
def second(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return float(f"{float(v):.9g}")
    return v.item() if isinstance(v, (np.integer, np.bool_)) else v


def rows(frame: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, sf_dir, second, name):
    got = own.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns)
    if name in own.SQL:
        want = second.execute(own.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(own.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
