"""Compares a query's rows with its oracle SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).to_arrow_table()


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns: list[str], records: list[dict]) -> list[tuple]:
    return sorted((tuple(_cell(r[c]) for c in sorted(columns)) for r in records), key=repr)


def compare(df, sql: str, sf_dir: str) -> str:
    """"ok n" or what differs."""
    got, want = [r.asDict() for r in df.collect()], oracle(sql, sf_dir)
    if sorted(df.columns) != sorted(want.column_names):
        return f"columns {sorted(df.columns)} and {sorted(want.column_names)}"
    a, b = rows(df.columns, got), rows(df.columns, want.to_pylist())
    if a == b:
        return f"ok {len(a)}"
    odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"differs: {len(a)} and {len(b)} rows, {odd}"
