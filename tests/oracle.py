"""Runs a query and its oracle SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    con = connection(sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not different, (len(different), different[:3])
