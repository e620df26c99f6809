"""Compare a Spark result with the SQL twin in DuckDB, value by value."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        f = round(float(v), 6)
        return 0.0 if f == 0 else f
    return str(v)


def as_counter(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted = as_counter(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(t) != kinds[c]}
    if odd:
        return f"types differ: {odd}"
    got = as_counter(df.columns, [tuple(r) for r in df.collect()])
    if got == wanted:
        return None
    extra, lacking = got - wanted, wanted - got
    return (f"{sum(got.values())} vs {sum(wanted.values())} rows; {sum(extra.values())} extra "
            f"e.g. {list(extra)[:2]}; {sum(lacking.values())} lacking e.g. {list(lacking)[:2]}")
