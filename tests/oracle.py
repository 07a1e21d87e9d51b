"""Runs a query's SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def normal(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr([normal(r[k]) for k in order]) for r in data)


def assert_equal(df, sql: str, con) -> None:
    found = con.execute(sql)
    expected = rows([c[0] for c in found.description], found.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected
