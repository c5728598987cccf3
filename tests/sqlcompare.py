"""Runs a query and its SQL over one data folder and compares rows by value."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.8g}".replace("-0", "0") if float(x) == 0 else f"{float(x):.8g}"
    return str(x)


def rows(columns, data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql: str) -> None:
    df = query(spark, str(DATA))
    got = rows(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, found.fetchall())
