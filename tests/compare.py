"""Compare a Spark query with its SQL in DuckDB, value by value and without order."""

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return con


def cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    kind = type(v).__name__
    if "float" in kind:
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    if "int" in kind:
        return str(int(v))
    return str(v).removesuffix(" 00:00:00")


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))
