"""Rows of Spark and DuckDB in one comparable form."""

import os

import duckdb


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.7g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def database(folder):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*columns).collect())
    assert got == want
