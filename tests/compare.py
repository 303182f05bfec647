"""Run a registered query next to its check SQL and compare every value."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def sf_dir(sf: str) -> str:
    return f"{TESTDATA}/sf{sf}"


def duck(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    table = df.toArrow()
    cols = table.column_names
    return normal(cols, list(zip(*[table.column(c).to_pylist() for c in cols])) if cols else [])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return normal(names, cur.fetchall())


def differences(got, want, limit=5):
    """Empty string when equal; else a short account of the first differences."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; spark {got[1][:2]} sql {want[1][:2]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)} of {len(want[1])} rows differ: " + "; ".join(f"{g} != {w}" for g, w in bad[:limit])
    return ""
