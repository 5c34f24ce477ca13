"""Runs a query and its oracle over the same folder and compares their rows."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return None
    return f"{float(x):.5f}" if isinstance(x, (float, np.floating)) else str(x)


def rows(df):
    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


def same(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
