"""Side-by-side run of registered queries and their SQL checks."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (list, tuple)):
        return repr([_plain(v) for v in value])
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def _kind(name: str) -> str:
    name = name.lower()
    if name.startswith(("timestamp", "datetime")):
        return "timestamp"
    return {"bigint": "bigint", "long": "bigint", "varchar": "string", "int": "integer"}.get(name, name)


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, otherwise a description of the first difference."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: _kind(str(d[1])) for d in res.description}
    expected = res.fetchall()
    got_names = spark_df.columns
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} != {sorted(names)}"
    got_kinds = {n: _kind(t) for n, t in spark_df.dtypes}
    odd = {n: (got_kinds[n], kinds[n]) for n in names if got_kinds[n] != kinds[n] and "array" not in got_kinds[n]}
    if odd:
        return f"types differ {odd}"
    got = _rows(got_names, [tuple(r) for r in spark_df.collect()])
    want = _rows(names, expected)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(got_names)}): {bad[0]}"
    return None if got else "no rows on either side"
