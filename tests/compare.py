"""Rows of a Spark result and of SQL on the same tables, in one comparable form."""

import numbers

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


def plain(v):
    """Numbers by value, whatever their type; no value as null."""
    if pd.isna(v):
        return "null"
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return str(int(v)) if v == int(v) else repr(round(float(v), 6))
    return str(v)
