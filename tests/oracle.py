"""Runs a query beside its SQL and compares rows, order aside."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(sf_dir=DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(df, sql, connection):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), names)
