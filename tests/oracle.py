"""Compares a query's rows with its SQL's, run by DuckDB."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in (v.tolist() if hasattr(v, "tolist") else v)) if not isinstance(v, (int, float)) else v
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.12g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def both(spark, f, sql: str, sf_dir: str):
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    wanted = sorted(repr(tuple(plain(dict(zip(rel.columns, r))[c]) for c in names)) for r in rel.fetchall())
    return got, wanted
