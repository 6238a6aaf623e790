"""Comparison of a query's rows with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v is pd.NA or v is pd.NaT or v != v else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
