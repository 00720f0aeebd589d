"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}: only spark {extra}; only sql {lost}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference\n  spark {g}\n  sql   {w}"
    types = {n: t for n, t in df.dtypes}
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for n in names:
        s, d = types[n], kinds[n]
        pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN"}
        if s in pairs and d not in (pairs[s], "STRING", "NUMBER", "bool", "Date"):
            return f"type of {n}: {s} != {d}"
        if s not in pairs:
            return f"type of {n}: {s}"
    return None if got else "no rows"
