"""Run a query and its SQL on the same tables and compare all values."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def _value(v):
    if v is None or str(v) == "<NA>":
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_value, r)) for r in frame.itertuples(index=False)), key=repr)


def assert_same(spark, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
