"""Spark rows against DuckDB rows: columns by name, rows in any order, doubles to nine digits."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as c:
        for t in TABLES:
            if Path(f"{sf_dir}/{t}.parquet").exists():
                c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        c.sql("SET TimeZone = 'UTC'")
        found = c.sql(sql)
        return sorted(found.columns), rows_of(found.columns, found.fetchall())


def same(df, sql: str, sf_dir: str) -> int:
    """Assert that both have the same columns and rows; the number of rows."""
    columns, expected = oracle(sql, sf_dir)
    assert sorted(df.columns) == columns
    got = rows_of(df.columns, df.collect())
    assert len(got) == len(expected), f"{len(got)} rows, not {len(expected)}; {got[:2]}; {expected[:2]}"
    assert got == expected, next((g, e) for g, e in zip(got, expected, strict=True) if g != e)
    return len(got)
