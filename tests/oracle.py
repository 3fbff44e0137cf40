"""Runs a query and its SQL side by side."""

import os

import duckdb
import pandas as pd


def connection(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        name = f.split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{f}'")
    return con


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return int(x) if isinstance(x, float) and x == int(x) else x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(_cell, r)) for r in frame.itertuples(index=False)), key=repr)


def same(spark, con, query, sql, folder):
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
