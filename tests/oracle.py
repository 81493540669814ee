"""Rows of a query beside those of its SQL, as sorted text."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}" if abs(v) < 1e15 else repr(v)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(_cell(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))
