"""Side by side: a query's rows against its SQL in DuckDB, values compared as text, in any order."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def text(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6f}".replace("-0.000000", "0.000000")
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in data)


def differences(spark, name, query, sql, sf_dir):
    cursor = connect(sf_dir).execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = rows(want_columns, cursor.fetchall())
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(want_columns)}"
    if got != want:
        extra = [x for x in got if x not in set(want)][:2]
        missing = [x for x in want if x not in set(got)][:2]
        return f"{name}: {len(got)} and {len(want)} rows; only here {extra}, only there {missing}"
    return ""
