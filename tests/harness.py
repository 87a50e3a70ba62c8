"""Runs a registered query and its SQL over the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
    return got
