"""Compare registered queries with their SQL counterparts in DuckDB."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable", na_position="last").reset_index(drop=True)


def differences(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> list[str]:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(oracle_df.columns)}"]
    if len(spark_df) != len(oracle_df):
        return [f"rows {len(spark_df)} vs {len(oracle_df)}"]
    a, b = canonical(spark_df), canonical(oracle_df)
    out = []
    for c in a.columns:
        bad = [(x, y) for x, y in zip(a[c], b[c])
               if not (x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)))]
        if bad:
            out.append(f"{c}: {len(bad)} of {len(a)} differ, first {bad[0]}")
    return out
