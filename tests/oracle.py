"""Runs SQL in DuckDB over the test tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.sql(sql).df()


def flat(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(str(tuple(str(v) for v in r)) for r in frame.itertuples(index=False))
