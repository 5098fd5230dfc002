"""Compares a query with its SQL in DuckDB, rows in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    def text(v) -> str:
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6)) if isinstance(v, float) else str(int(v)) if hasattr(v, "__index__") else str(v)

    out = df[sorted(df.columns)].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> bool:
    a, b = canonical(spark_rows), canonical(sql_rows)
    return list(a.columns) == list(b.columns) and len(a) > 0 and a.equals(b)
