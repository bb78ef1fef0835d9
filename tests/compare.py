"""Run a registered query and its SQL twin and describe any difference."""

from __future__ import annotations

import datetime
import math

import duckdb

# The tables every SQL twin may read.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, datetime.datetime):
        return v.date()
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else "") for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=_key)


def difference(df, con, sql: str) -> str | None:
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(want_names, want)
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(g) != len(w):
        return f"{len(g)} rows != {len(w)}"
    types = [
        (c, type(a).__name__, type(b).__name__)
        for ra, rb in zip(g[:50], w[:50])
        for c, a, b in zip(gc, ra, rb)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    if types:
        return f"types differ {sorted(set(types))}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)} of {len(g)} rows differ on {gc}: {bad[:2]}"
    return None
