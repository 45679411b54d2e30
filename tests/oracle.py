"""Comparison of a query with its check SQL, as order-free sets of rows."""

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        p = os.path.join(sf_dir, f)
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW \"{f[:-8]}\" AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canon(df):
    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, float):
            return f"{x + 0.0:.9g}"
        return str(x)[:10] if hasattr(x, "isoformat") else str(x)

    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.map(text).itertuples(index=False)))
