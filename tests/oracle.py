"""Compares a query with its SQL in DuckDB, row for row, in any order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def rows_of(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted(got.columns), Counter(tuple(row[i] for i in order) for row in got.fetchall())


def assert_same(df, folder: str, sql: str) -> None:
    names, expected = rows_of(folder, sql)
    assert sorted(df.columns) == names
    assert Counter(tuple(r) for r in df.select(*names).collect()) == expected
