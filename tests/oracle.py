"""Comparing a query with its SQL, as the driver does."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)
