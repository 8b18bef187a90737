"""Rows of Spark and of DuckDB, compared without order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "NULL" if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else f"{x:.9g}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    a, b = plain(a), plain(b)
    assert list(a.columns) == list(b.columns)
    assert a.shape == b.shape
    wrong = (a != b).any(axis=1)
    assert not wrong.any(), f"\n{a[wrong].head()}\n{b[wrong].head()}"
