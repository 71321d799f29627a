"""A query and its SQL side by side."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) and x == int(x) and abs(x) < 2**53:
        return int(x)
    return x


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in frame[names].astype(object).itertuples(index=False)), key=str)


def differences(spark, folder, query, sql):
    got, want = rows(query(spark, folder).toPandas()), rows(connect(folder).execute(sql).df())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    a, b = [r for r in got[1] if r not in set(want[1])][:3], [r for r in want[1] if r not in set(got[1])][:3]
    return f"{len(got[1])} and {len(want[1])} rows; only in Spark {a}; only in SQL {b}"
