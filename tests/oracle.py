"""Run a query and its SQL text over the same tables and compare the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}" if abs(v) < 1e6 else f"{v:.8g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple"):
        return norm(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir, query, sql):
    """None if both agree, else a short description."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = connect(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if got != want:
        left, right = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        return f"{len(got)} rows against {len(want)}; only in Spark {left[:3]}; only in SQL {right[:3]}"
    if not got:
        return "no rows"
    return None
