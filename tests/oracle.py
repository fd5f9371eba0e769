"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        at += "/*.parquet" if os.path.isdir(at) else ""
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    return c


def _plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 9))
    if hasattr(x, "year"):
        return str(pd.Timestamp(x))
    if hasattr(x, "tolist"):
        x = x.tolist()
        return repr(round(x, 9)) if isinstance(x, float) else str(x)
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_plain(x) for x in r) for r in zip(*(frame[c].tolist() for c in columns), strict=True))


def assert_same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    float_columns = [c for c in found.columns if "float" in (str(found[c].dtype), str(expected[c].dtype)) or found[c].dtype.kind == "f" or expected[c].dtype.kind == "f"]
    for f in (found, expected):
        for c in float_columns:
            f[c] = f[c].astype(float)
    assert rows(found) == rows(expected)
