"""Run queries in both engines and report the differences."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


KINDS = {"i": "integer", "u": "integer", "f": "float", "b": "bool", "O": "object"}


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} / {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    for c in a.columns:
        x, y = a[c].astype(object).where(a[c].notna(), None), b[c].astype(object).where(
            b[c].notna(), None)
        bad = [i for i in range(len(a)) if not (x[i] == y[i] or (x[i] is None and y[i] is None))]
        if bad:
            i = bad[0]
            return f"column {c}: {len(bad)} values differ, first {x[i]!r} / {y[i]!r}"
        # Whole numbers with nulls are float64 in one engine's frame and Int64 in the other's.
        whole = a[c].isna().any() and {str(a[c].dtype), str(b[c].dtype)} == {"float64", "Int64"}
        if a[c].dtype != b[c].dtype and len(a) and not whole:
            return f"column {c}: types {a[c].dtype} / {b[c].dtype}"
    return None
