"""scalar_floats and its operators on nulls, fractions, infinities and numbers beyond 64-bit integers."""

import math

import duckdb
from pyspark.sql import functions as F

from moraine import plans
from moraine.functions import floats

QUANTITY = [None, 0.0, 24.4, 24.43, 24.5, 36.83, 49.44, 12.1, 11.95, 1e17, 1e19, -1e19, 1e30, math.inf, -math.inf]
DISCOUNT = [None, 0.0, 0.04, 0.045, 0.05, 0.055, 1e17, math.inf, -math.inf]


def test_scalar_floats_on_odd_numbers(spark, tmp_path):
    rows = [(k, 1, q, d) for k, (q, d) in enumerate((q, d) for q in QUANTITY for d in DISCOUNT)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = plans.QUERIES["scalar_floats"](spark, str(tmp_path))
    want = con.sql(plans.ORACLES["scalar_floats"])
    got = sorted(repr(tuple(r[c] for c in want.columns)) for r in df.collect())  # the sign of a zero counts
    assert len(got) == len(rows) and got == sorted(map(repr, want.fetchall()))


def test_rounding_keeps_signs_and_numbers_beyond_integers(spark):
    odd = [-0.5, -0.0, 0.5, -1.5, 1e300, -1e300, math.inf, math.nan, None]
    df = spark.createDataFrame([(x,) for x in odd], "x double")
    got = [tuple(map(repr, r)) for r in df.select(floats.ceil(F.col("x")), floats.floor(F.col("x")), floats.trunc(F.col("x"))).collect()]
    assert got == [("-0.0", "-1.0", "-0.0"), ("-0.0", "-0.0", "-0.0"), ("1.0", "0.0", "0.0"), ("-1.0", "-2.0", "-1.0"), *[(repr(x),) * 3 for x in odd[4:]]]


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None, 0.0), (1.0, None), (None, None)], "a double, b double")
    got = df.select(floats.fdiv(F.col("a"), F.col("b")), floats.to_sint_sat(F.col("a") + F.col("b"), 8), floats.to_uint_sat(F.col("a") + F.col("b"), 8)).collect()
    assert [tuple(r) for r in got] == [(None,) * 3] * 3


def test_sign_of_a_zero(spark):
    df = spark.createDataFrame([(1.0, -0.0), (-1.0, -0.0), (1.0, 0.0)], "a double, b double")
    got = [tuple(r) for r in df.select(floats.fdiv(F.col("a"), F.col("b")), floats.fcopysign(F.col("a"), F.col("b"))).collect()]
    assert got == [(-math.inf, -1.0), (math.inf, -1.0), (math.inf, 1.0)]
