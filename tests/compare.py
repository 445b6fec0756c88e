"""Results side by side with DuckDB's, without regard to order."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT:
        return "∅"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return "∅" if v != v else f"{float(v):.9g}"
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    return str(v)


def table(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(zip(*[[cell(v) for v in df[c].astype(object)] for c in sorted(df.columns)], strict=True))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
