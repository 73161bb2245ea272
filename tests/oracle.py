"""Compare registered queries with DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        return repr(round(v, 9)) if math.isfinite(v) else repr(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, sf_dir):
    """Problems found (empty when equal), row count and seconds."""
    start = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, df.collect()
    seconds = time.time() - start
    problems = []
    if sql is None:
        return problems, len(got), seconds
    want_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} != {sorted(want_cols)}"], len(got), seconds
    for c, t in df.dtypes:
        if TYPES[t] != want_types[c]:
            problems.append(f"type of {c}: {t} vs {want_types[c]}")
    a, b = rows(got_cols, got), rows(want_cols, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3]
        missing = [x for x in b if x not in set(a)][:3]
        problems.append(f"{len(a)} rows vs {len(b)}; only ours {extra}; only theirs {missing}")
    return problems, len(got), seconds
