"""Runs a query and its SQL over the same folder of parquet tables."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        source = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


def compare(spark, folder, query, sql):
    df = query(spark, folder)
    r = connect(folder).execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    own = sorted(repr([plain(row[c]) for c in sorted(names)]) for row in df.collect())
    other = sorted(repr([plain(row[names.index(c)]) for c in sorted(names)]) for row in r.fetchall())
    assert own == other
