"""A query's rows beside those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads to 2")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP"}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and SQL: columns, types, rows."""
    rel = con.sql(sql)
    out = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} and {sorted(rel.columns)}"]
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    out += [f"{c}: {t} and {kinds[c]}" for c, t in df.dtypes if _KINDS.get(t, t) != kinds[c]]
    a, b = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    if not a:
        out.append("no rows")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}"[:1500])
    return out
