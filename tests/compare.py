"""Compares a query with its oracle as the driver does: rows in any order, columns by name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    cur = con.execute(sql)
    b = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert a[0] == b[0], (name, a[0], b[0])
    assert len(a[1]) == len(b[1]), (name, len(a[1]), len(b[1]))
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not bad, (name, bad[:3])
    return len(a[1])
