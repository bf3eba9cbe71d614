"""Reshaping of columns and run logs on small values."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import columns, runlog


def test_orientation(spark):
    df = spark.createDataFrame([([[1, 2], [3, 4]],), ([[1, 2, 3], [4, 5, 6]],), ([[1, 2], [3, 4], [5, 6]],), ([],)], "e array<array<long>>")
    got = [r.e for r in df.select(columns.oriented(F.col("e")).alias("e")).collect()]
    assert got == [[[1, 2], [3, 4]], [[1, 4], [2, 5], [3, 6]], [[1, 2], [3, 4], [5, 6]], []]
    bad = spark.createDataFrame([([[1, 2, 3]],)], "e array<array<long>>")
    with pytest.raises(Exception, match="neither"):
        bad.select(columns.oriented(F.col("e"))).collect()


def test_heads_must_not_share_names(spark):
    with pytest.raises(ValueError):
        columns.merge_columns(spark.range(1), {"a": F.lit(1)}, {"a": F.lit(2)})


def test_profile(spark):
    row = columns.profile(lambda: 5, spark, steps=3, warm_up=1).first()
    assert row["min"] <= row["p50"] <= row["max"] and row["items_per_second"] > 0


def test_speed_windows(spark):
    df = spark.createDataFrame([("a", k, f"2024-01-01 00:00:{2 * k:02d}") for k in range(5)], "u string, k int, t string").withColumn("t", F.to_timestamp("t"))
    got = [(r.window, r.steps, r.seconds, r.speed) for r in runlog.step_speed(df, ["u"], ["k"], "t", 2).orderBy("window").collect()]
    assert got == [(0, 2, 2.0, 1.0), (1, 2, 4.0, 0.5), (2, 1, 2.0, 0.5)]


def test_best_so_far(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([3.0, 3.0, 2.0, 5.0, 1.0])], "u string, k int, v double")
    assert [r.k for r in df.withColumn("b", runlog.is_best(["u"], ["k"], "v")).filter("b").orderBy("k").collect()] == [0, 2, 4]
    assert [r.k for r in df.withColumn("b", runlog.is_best(["u"], ["k"], "v", "max")).filter("b").orderBy("k").collect()] == [0, 3]


def test_csv_fields(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.v for r in df.select(runlog.csv_field(F.col("v")).alias("v")).collect()] == ["1.5", "", "", ""]
