"""Run a named query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 6)
        return repr(v + 0.0)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "long", "hugeint") or t.startswith("decimal"):
        return "integer" if not t.startswith("decimal") else "decimal"
    return {"varchar": "string", "double": "double", "boolean": "boolean"}.get(t, t)


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree in columns, types and rows, else a description."""
    got_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = {c: kind(t) for c, t in df.dtypes}
    duck = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    types = {c: (spark_types[c], duck[c]) for c in names if spark_types[c] != duck[c]}
    got, want = rows_of(df.columns, got_rows), rows_of(names, want_rows)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {sorted(names)}: spark {bad[0][0]} sql {bad[0][1]}"
    if types:
        return f"types differ {types}"
    return None
