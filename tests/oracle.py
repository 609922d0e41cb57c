"""Runs queries beside their SQL in DuckDB and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is not None and type(v).__name__ in ("Decimal", "int64"):
        return round(float(v), 5)
    if isinstance(v, bool):
        return v
    return round(float(v), 5) if isinstance(v, int) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, f, sql):
    df = f(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b = rows(list(rel.columns), rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    for x, y in zip(a[1], b[1]):
        if x != y:
            k = next(i for i in range(len(x)) if x[i] != y[i])
            p = next((i for i, (c, d) in enumerate(zip(str(x[k]), str(y[k]))) if c != d), 0)
            return f"{a[0][k]}: {str(x[k])[max(0, p - 40) : p + 60]!r} and {str(y[k])[max(0, p - 40) : p + 60]!r}"
    return "" if a[1] else "no rows"
