"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("QUERN_TEST_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: _plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if type(v).__name__ == "Decimal":
        return _plain(float(v))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, sql: str, sf_dir: str) -> str:
    """'' where the rows agree, else what differs."""
    c = connection(sf_dir)
    got_names, got = rows_of(df.columns, df.collect())
    r = c.execute(sql)
    want_names, want = rows_of([x[0] for x in r.description], r.fetchall())
    if got_names != want_names:
        return f"columns {got_names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} and {want[:2]}"
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(odd)} rows differ, as {odd[0]}" if odd else ""
