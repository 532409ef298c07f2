"""Compares a query with its SQL in DuckDB over the same tables: rows, columns and values, in any order."""

import datetime
import math
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    return v if v is None or isinstance(v, (bool, str)) else str(v)


def differences(spark, sf, query, sql):
    df = query(spark, sf)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in res.fetchall())
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if got != want:
        return f"{sum(got.values())} rows, {sum(want.values())} expected; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return ""
