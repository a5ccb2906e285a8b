"""Compares queries with their SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, sf_dir: str) -> str | None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    theirs = _rows([d[0] for d in found.description], found.fetchall())
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
        return f"{len(mine[1])} and {len(theirs[1])} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    return None
