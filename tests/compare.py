"""A Spark result against the same rows from DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return ""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool | int | float):
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return str(v)


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in r) for r in frame[names].itertuples(index=False))
