"""Compares a Spark result with DuckDB's rows: columns by name, rows in any order."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return ""
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}" if float(v) else "0"
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_plain, r)) for r in frame.itertuples(index=False)), key=str)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both are equal."""
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows(a), rows(b)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows; first {x[:2]} and {y[:2]}"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} of {len(x)} rows differ: {bad[:2]}" if bad else ""
