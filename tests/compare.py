"""Compares a Spark query with its DuckDB SQL, as sorted rows of equally named columns."""

import glob
import math
import os
from numbers import Real

import duckdb
import numpy as np


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        path = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>") else round(float(v), 6) if isinstance(v, Real) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r))
    return sorted(out, key=str)


def same(spark, con, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
