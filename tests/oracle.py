"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v) -> str:
    """A value as text; floats to nine digits, times without their zone."""
    if v is None or v != v:
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.astimezone(dt.UTC).replace(tzinfo=None).isoformat() if v.tzinfo else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def spark_rows(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted("|".join(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[str]]:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted("|".join(plain(r[k]) for k in order) for r in found.fetchall())
