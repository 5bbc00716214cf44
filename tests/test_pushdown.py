"""Comparisons of filter clauses reach the scan, and mean what they meant above it."""

from __future__ import annotations

import re
from datetime import datetime

import pytest

from lodestone.operators.filters import Schema, prop, where

ORDERS = Schema({"o_orderpriority": "field"})


def pushed(df) -> str:
    plan = df._jdf.queryExecution().toString()
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\](?:,|\n)", plan))


@pytest.mark.parametrize(
    ("table", "clause", "want"),
    [
        ("orders", prop("o_custkey") == 7, ["IsNotNull(o_custkey)", "EqualTo(o_custkey,7)"]),
        ("documents", prop("n_chars") > 3000, ["GreaterThan(n_chars,3000)"]),
        ("orders", prop("o_totalprice") < 20000.0, ["LessThan(o_totalprice,20000.0)"]),
        ("orders", (prop("o_totalprice") >= 100000.0) & (prop("o_totalprice") < 110000.0), ["GreaterThanOrEqual(o_totalprice,100000.0)", "LessThan(o_totalprice,110000.0)"]),
        ("events", prop("event_id") >= 900, ["GreaterThanOrEqual(event_id,900)"]),
        ("events", prop("ts") >= datetime(2024, 1, 2), ["GreaterThanOrEqual(ts,2024-01-02"]),
        ("documents", prop("n_chars") != 1000, ["Or(IsNull(n_chars),Not(EqualTo(n_chars,1000)))"]),
        ("orders", prop("o_orderpriority") == "1-URGENT", ["StringStartsWith(o_orderpriority,1-URGENT)"]),
        ("orders", (prop("o_custkey") == 7) | (prop("o_custkey") == 9), ["Or(EqualTo(o_custkey,7),EqualTo(o_custkey,9))"]),
        ("orders", prop("o_custkey").contains_any(7, 9), ["Or(EqualTo(o_custkey,7),EqualTo(o_custkey,9))"]),
    ],
)
def test_comparisons_are_pushed(spark, sf_dir, table, clause, want):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else plans are shown cut off
    found = pushed(where(spark.read.parquet(f"{sf_dir}/{table}.parquet"), clause, ORDERS))
    assert all(w in found for w in want), found


def test_missing_values_and_complements(spark):
    rows = [(1, 5, "a"), (2, None, " a\t"), (3, 7, None), (4, None, "ab"), (5, 7, "　a "), (6, 5, "b")]
    df = spark.createDataFrame(rows, "id int, n int, s string")
    schema = Schema({"s": "field"})
    ids = lambda c: sorted(r.id for r in where(df, c, schema).collect())
    assert ids(prop("n") > 5) == [3, 5] and ids(~(prop("n") > 5)) == [1, 2, 4, 6]
    assert ids(prop("n") != 5) == [2, 3, 4, 5] and ids(~(prop("n") != 5)) == [1, 6]
    assert ids(prop("s") == "a") == [1, 2, 5] and ids(prop("s") != "a") == [3, 4, 6] and ids(~(prop("s") == "a")) == [3, 4, 6]
    assert ids(~((prop("n") == 5) & (prop("s") == "a"))) == [2, 3, 4, 5, 6]
    assert ids(prop("n").contains_none(5, 9)) == [2, 3, 4, 5] and ids((prop("n") == 7) | (prop("s") == "b")) == [3, 5, 6]


def test_nested_paths_and_ids(spark):
    rows = [(1, ("x", 3), [(1,), (2,)], "6f3ee4b2-8f6c-4d8c-9f7f-0e4e6a2c1b11"), (2, None, [(5,)], "other"), (3, ("y", None), None, None)]
    df = spark.createDataFrame(rows, "id int, a struct<s:string,n:int>, many array<struct<k:int>>, u string")
    schema = Schema({"a.s": "field", "u": "id"})
    ids = lambda c: sorted(r.id for r in where(df, c, schema).collect())
    assert ids(prop("a.n") == 3) == [1] and ids(prop("a.s") == "y") == [3] and ids(prop("many.k") >= 2) == [1, 2] and ids(prop("a.n") != 3) == [2, 3]
    for spelling in ("6F3EE4B2-8F6C-4D8C-9F7F-0E4E6A2C1B11", "{6f3ee4b28f6c4d8c9f7f0e4e6a2c1b11}", "urn:uuid:6f3ee4b2-8f6c-4d8c-9f7f-0e4e6a2c1b11"):
        assert ids(prop("u") == spelling) == [1]
    with pytest.raises(ValueError):
        where(df, prop("a.z") == 1, schema)
