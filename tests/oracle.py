"""Compares a Spark result with DuckDB's as multisets of rows."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(x):
    if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 9)
    return int(x) if isinstance(x, np.integer) else x


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(map(_value, r)) for r in pdf.itertuples(index=False)), key=lambda r: [(v is None, str(v)) for v in r])


def assert_same(spark_df, sql, folder):
    a, b = spark_df.toPandas(), connect(folder).execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
