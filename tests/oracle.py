"""Compares a query with its SQL on the small tables."""

import os

import duckdb
import numpy as np
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def plain(value):
    if value is None or str(value) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    return round(float(value), 6) if isinstance(value, (int, float, np.number)) else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


def check(spark, con, query, sql):
    got, want = query(spark, SF_DIR).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    return len(got)
