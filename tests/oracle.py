"""Running a query and its SQL twin on the same tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v: object) -> object:
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(df: DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def expected(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
