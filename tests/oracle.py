"""Runs a query and its SQL twin and compares them as multisets of rounded rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def rows(frame) -> list[tuple]:
    def text(v):
        if v is None or pd.isna(v):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False))


def assert_same(spark_frame, sql: str, sf_dir: str) -> None:
    got, want = spark_frame.toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
