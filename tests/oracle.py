"""Compare a Spark result with DuckDB on the same parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "null"
        if isinstance(value, float):
            return repr(value)
        return f"{type(value).__name__[:3]}:{value}"

    columns = [[cell(v) for v in frame[c].tolist()] for c in frame.columns]
    return sorted(zip(*columns))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for name in got.columns:  # whole numbers with nulls come as floats from one side
        if str(want[name].dtype) == "Int64" and str(got[name].dtype) == "float64":
            got = got.assign(**{name: got[name].astype("Int64")})
    left, right = _canonical(got), _canonical(want)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}"
    return None
