"""Compares queries with their SQL on the same tables, as sorted rows of sorted columns."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings train_rows completions human_evals eval_items dataset_info mix_spec".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, folder: str, fn, sql: str) -> str | None:
    """None if both agree, else what differs first."""
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}; only here {list(set(got[1]) - set(want[1]))[:2]}; only SQL {list(set(want[1]) - set(got[1]))[:2]}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{sum(x != y for x, y in zip(got[1], want[1]))} differ: {a} against {b}"
    return None
