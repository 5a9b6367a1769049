"""Run a registered query in both engines and compare values, whatever the row order."""

from __future__ import annotations

import duckdb
import pandas as pd

from recon.sources.tables import TABLES


def open_duckdb(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (not isinstance(v, (list, tuple, dict)) and pd.api.types.is_scalar(v) and pd.isna(v)):
            return "~"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (float, int)) and not isinstance(v, bool):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty when equal, otherwise what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    left, right = _canonical(spark_frame), _canonical(sql_frame)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
