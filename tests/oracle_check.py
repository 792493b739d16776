"""Compare a Spark result with DuckDB's: same columns, same rows in any order, same values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, Counter(
        tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows
    )


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    result = con.execute(sql)
    expected = bag([d[0] for d in result.description], result.fetchall())
    found = bag(df.columns, df.collect())
    if found[0] != expected[0]:
        return f"columns {found[0]} instead of {expected[0]}"
    if found[1] != expected[1]:
        extra = list((found[1] - expected[1]).items())[:3]
        lacking = list((expected[1] - found[1]).items())[:3]
        sizes = f"{sum(found[1].values())} rows, expected {sum(expected[1].values())}"
        return f"{sizes}\n{found[0]}\nextra {extra}\nmissing {lacking}"[:3000]
    return None
