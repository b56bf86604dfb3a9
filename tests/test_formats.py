"""Texts of numbers against Python's own formats and the SQL of ``format_sizes``."""

import random

import duckdb
from pyspark.sql import functions as F

from kinfold.functions import formats
from kinfold.plans import catalogue


def test_fixed_rounds_the_binary_value(spark):
    rng = random.Random(5)
    xs = [1.15, 1.25, 1.35, 226.95, 0.05, 0.5, 1.5, 2.5, 0.125, 0.375, 1.005, 2.675, 1000.35, -1.15, -0.04, 0.0, 8.79e12, *(rng.randrange(1, 10**7) / 20 / 10 ** rng.randrange(4) for _ in range(5000))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(formats.fixed(F.col("x"), k).alias(f"f{k}") for k in range(3))).collect()
    assert len(got) == len(xs)
    for r in got:
        assert [r.f0, r.f1, r.f2] == [f"{r.x:.{k}f}" for k in range(3)]


def test_format_sizes_as_its_sql(spark, tmp_path):
    """Sizes at a decimal half, exact halves, null and negative numbers, long durations."""
    rows = [(84400, 5673.75), (1, 11500.0), (1, 12500.0), (3, 0.005), (1, 0.005), (1, 0.015), (5, None), (None, 1.0), (-65, 1.0), (-5, 20.0), (0, 3.0), (59, 0.0), (60, 1.0), (3599, 10.24), (3600, 2.0), (9_007_199_254_740_993, 20.0), (999, 99_999_999.99)]
    rows += [(k, c * 500.0) for k in (1, 999, 1001, 2003) for c in range(1, 400, 2)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(f"select o_orderkey, by_1024, by_1000, took from ({catalogue.SQL['format_sizes']})").fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["format_sizes"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
