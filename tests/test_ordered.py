"""What looks back over groups that span partitions, against windows and plain loops."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import collate, ordered, runlog
from graphloom.plans import cache
from graphloom.schema import GraphBatch


@pytest.fixture(params=[1, 7])
def parts(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, hot: bool):
    rng = random.Random(1)
    made = [(None if rng.random() < 0.1 else ("a" if hot or rng.random() < 0.5 else "b"), k, rng.choice([None, 1.0, 2.0, 3.0, 2.5]), rng.choice(["x", "y", None])) for k in range(120)]
    return spark.createDataFrame(made, "g string, k int, v double, c string")


@pytest.mark.parametrize("hot", [True, False])
def test_looks_are_windows(spark, parts, hot):
    df = rows(spark, hot)
    looks = {"n": ordered.number(), "s": ordered.total("v"), "lo": ordered.least("v"), "hi": ordered.largest("v"), "p": ordered.previous("c"), "l": ordered.last_known("v")}
    out = ordered.looking_back(df, ["g"], ["k"], looks, sizes="size")
    w = W.partitionBy("g").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    one = W.partitionBy("g").orderBy("k")
    want = df.select(
        "*", (F.row_number().over(one) - 1).alias("n"), F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"),
        F.lag(F.struct(F.col("c").alias("value"))).over(one).alias("p"), F.last("v", ignorenulls=True).over(w).alias("l"), F.count("*").over(W.partitionBy("g")).alias("size"),
    )
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    if parts > 1 and hot:
        written = spark.read.parquet(out.written_to[0])
        assert written.filter("g = 'a'").select("_part").distinct().count() > 1
    cache.drop_written(spark, out.written_to[0])
    assert ordered.looking_back(df.limit(0), ["g"], ["k"], looks).count() == 0


def test_run_logs_over_partitions(spark, parts):
    df = rows(spark, True).filter("g = 'a'")
    one = [tuple(r) for r in df.orderBy("k").collect()]
    best, want = None, []
    for _, k, v, _ in one:
        if v is None or best is None or v < best:
            want.append(k)
        best = v if best is None else min(best, v) if v is not None else best
    assert [r.k for r in runlog.best_so_far(df, ["g"], ["k"], "v").filter("best").orderBy("k").collect()] == want
    changed = [k for i, (_, k, _, c) in enumerate(one) if i == 0 or c != one[i - 1][3]]
    assert [r.k for r in runlog.changes(df, ["g"], ["k"], "c").filter("changed").orderBy("k").collect()] == changed
    kept = {r.k: r.kept_as for r in runlog.kept_checkpoints(df, ["g"], ["k"], "v", every=10).collect()}
    assert {k for k, why in kept.items() if "best" in why} == set(want) and [k for k, why in kept.items() if "last" in why] == [one[-1][1]]
    assert sorted(k for k, why in kept.items() if "periodic" in why) == [k for _, k, _, _ in one[9::10]]
    heads = df.withColumn("kind", F.when(F.col("k") % 3 == 0, "header").otherwise("row"))
    last, stay = object(), []
    for _, k, _, c in one:
        if k % 3 == 0:
            if c != last and not (c is None and last is None):
                stay.append(k)
            if c is not None:
                last = c
        else:
            stay.append(k)
    got = [r.k for r in runlog.first_headers(heads, ["g"], ["k"], columns="c").orderBy("k").collect()]
    assert [k for k in got if k > 10] == [k for k in stay if k > 10]


def test_no_window_spans_a_group(spark):
    df = rows(spark, True)
    atoms = df.selectExpr("1L AS graph_id", "cast(k AS bigint) AS atom_id")
    batch = collate.collated(GraphBatch(atoms), spark.createDataFrame([(1, 0)], "graph_id long, batch_id long"))
    for out in (runlog.best_so_far(df, ["g"], ["k"], "v"), runlog.changes(df, ["g"], ["k"], "c"), batch.atoms.select("atom_id", "index")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        own = [line for line in plan.splitlines() if "Window [" in line]
        assert own and all("_part" in line for line in own if "batch_id" not in line)
    assert {r.atom_id: r["index"] for r in batch.atoms.collect()} == {k: k for k in range(120)}
