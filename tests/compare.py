"""Holds registered queries against their SQL on DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and SQL's rows: columns by name, rows in any order."""
    got = con.sql(sql)
    names = sorted(df.columns)
    if sorted(got.columns) != names:
        return [f"columns {names} and {sorted(got.columns)}"]
    a = sorted((repr(plain(tuple(r[n] for n in names))) for r in df.select(*names).collect()))
    b = sorted(repr(plain(r)) for r in got.select(*[f'"{n}"' for n in names]).fetchall())
    if a == b:
        return []
    more, less = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return [f"{len(a)} and {len(b)} rows; ours alone {more}; SQL's alone {less}"]
