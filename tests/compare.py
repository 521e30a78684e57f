"""Compare Spark results with SQL results the way a value hash would."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))
    return [cols[i] for i in order], out


def diff(df, con, sql: str, show: int = 3) -> str | None:
    """None when equal, else a short description."""
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    otypes = [str(d[1]) for d in cur.description]
    orows = cur.fetchall()
    srows = [tuple(r) for r in df.collect()]
    sc, st = table(srows, df.columns)
    oc, ot = table(orows, ocols)
    if sc != oc:
        return f"columns {set(sc) ^ set(oc)}"
    if len(st) != len(ot):
        return f"rows {len(st)} vs {len(ot)}"
    bad = [(a, b) for a, b in zip(st, ot) if a != b]
    kinds = {"DOUBLE": "double", "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = dict(df.dtypes)
    odd = [f"{c}: {types[c]} vs {t}" for c, t in zip(ocols, otypes) if kinds.get(t, t) != types[c]]
    msg = []
    if odd:
        msg.append("types " + "; ".join(odd))
    if bad:
        msg.append(f"{len(bad)} of {len(st)} rows differ")
        for a, b in bad[:show]:
            msg.append(str([(n, x, y) for n, x, y in zip(sc, a, b) if x != y][:4]))
    return " | ".join(msg) if msg else None
