"""Holds rows of Spark against rows of DuckDB."""

import glob
import math
import os

import duckdb


def tables(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return c


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v) + 0.0)
    return repr(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


def same(df, sql, folder):
    c = tables(folder)
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, got.fetchall())
    assert len(a) == len(b)
    assert a == b
