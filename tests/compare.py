"""Rows of a Spark result and of DuckDB, made comparable."""

import decimal
import math
import os

import duckdb

DATA = os.environ.get("MORAINE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=DATA):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if math.isfinite(v) and v == int(v) and abs(v) < 1e15 else float("%.9g" % v))
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float("%.9g" % v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def same(df, sql, con):
    cols = sorted(df.columns)
    spark_rows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in (x.asDict(True) for x in df.collect()))
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    duck_rows = sorted(repr(tuple(norm(r[i]) for i in at)) for r in res.fetchall())
    assert spark_rows == duck_rows
