"""Streams of two micro-batches against the batch functions."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import runlog
from graphloom.session import table
from graphloom.streaming import runlog as streamed
from graphloom.streaming.metrics import run_available

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Events in two files, the later ones in the second, and the stream that takes one file at a time."""
    path = str(tmp_path_factory.mktemp("events"))
    events = table(spark, SF, "events").select("event_id", "user_id", "ts", "value", "event_type").withColumn("user_id", F.col("user_id") % 5)
    events = events.withColumn("value", F.when(F.col("event_id") % 11 > 0, F.col("value")))
    cut = events.agg(F.percentile("event_id", 0.5)).first()[0]
    order = events.selectExpr("*", "row_number() OVER (ORDER BY ts, event_id) AS rn")
    for k, part in enumerate((order.filter(F.col("rn") <= cut), order.filter(F.col("rn") > cut))):
        part.drop("rn").coalesce(1).write.mode("append").parquet(path)
        assert k < 2
    return events, lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_best_and_changes(spark, halves):
    events, stream = halves
    batches = []
    tracked = streamed.tracked(stream(), ["user_id"], ["ts", "event_id"], best="value", watched="event_type")
    got = run_available(tracked, "append").select("event_id", "best", "changed")
    want = runlog.best_so_far(events, ["user_id"], ["ts", "event_id"], "value").select("event_id", "best")
    want = want.join(runlog.changes(events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "changed"), "event_id")
    assert rows(got) == rows(want) and len(rows(got)) == events.count() and not batches


def test_headers(spark, halves):
    events, stream = halves
    named = lambda df: df.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, "header").otherwise("row").alias("kind"), F.col("event_type").alias("columns"))
    got = run_available(streamed.first_headers(named(stream()), ["user_id"], ["ts", "event_id"]), "append")
    assert rows(got.select("event_id")) == rows(runlog.first_headers(named(events), ["user_id"], ["ts", "event_id"]).select("event_id"))


def test_speed_of_full_windows(spark, halves):
    events, stream = halves
    got = run_available(streamed.step_speed(stream().select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "ts", 7), "append")
    want = runlog.step_speed(events, ["user_id"], ["ts", "event_id"], "ts", 7).filter("steps = 7")
    shown = ["user_id", "window", "steps", "round(seconds, 6) AS seconds", "round(speed, 6) AS speed"]
    assert rows(got.selectExpr(*shown)) == rows(want.selectExpr(*shown)) and got.count() > 20
