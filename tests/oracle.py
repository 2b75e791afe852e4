"""Runs queries against their SQL, compared as multisets of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def compare(df, con, sql: str) -> str:
    """'' if both agree, else what differs."""
    cols = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({sql}) AS q")
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    names = sorted(d[0] for d in con.execute(f"SELECT * FROM ({sql}) AS q LIMIT 0").description)
    if names != cols:
        return f"columns {cols} against {names}"
    if want == got:
        return "" if want else "no rows"
    return f"{sum(got.values())} rows against {sum(want.values())}; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
