"""Rows of a Spark query and of its SQL in DuckDB, in one comparable form."""

import decimal
import glob
import os

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(_cell, v)) + "]"
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, decimal.Decimal, np.integer, np.floating)):
        return f"{float(v):.6g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in df.itertuples(index=False, name=None))
