"""Rows of a Spark query against rows of a DuckDB statement over the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def assert_same(df, con, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    kinds = dict(zip(found.columns, map(str, found.types)))
    assert not [(c, t, kinds[c]) for c, t in df.dtypes if TYPES.get(t, kinds[c]) != kinds[c]]
    at = [found.columns.index(c) for c in order]
    ours = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs, [x for x in zip(ours, theirs) if x[0] != x[1]][:3]
