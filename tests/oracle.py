"""Comparison of a query with its SQL counterpart on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else repr(v)) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=_sortable)


def same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, limit: int = 5) -> list[str]:
    """Empty when column names, row count, types and every value agree."""
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    if not got:
        return ["no rows on either side"]
    out = []
    for g, w in zip(got, want):
        if not all(same(a, b) for a, b in zip(g, w)):
            out.append(f"{g} != {w}")
            if len(out) == limit:
                break
    return out
