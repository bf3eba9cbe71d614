"""Exact percentiles by selection of ranks, and metrics of merged states."""

import numpy as np
import pytest

from graphloom.operators import metrics


@pytest.mark.parametrize("task_values,ranges", [(1 << 16, 1024), (8, 64)])
def test_percentiles_are_exact(spark, task_values, ranges):
    rng = np.random.default_rng(1)
    groups = {"even": rng.uniform(size=301), "heavy": 10.0 ** rng.uniform(-20, 20, 200), "same": np.full(50, 2.5), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([7.0]), None: np.array([1.0, 2.0]), "wide": np.array([-1.7e308, 0.0, 1.7e308])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    at = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.95, "e": 1.0}
    out = metrics.percentiles(df, ["g"], "v", at, task_values=task_values, ranges=ranges)
    got = {r.g: [r[n] for n in at] for r in out.collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        if g != "wide":
            assert got[g] == pytest.approx(np.percentile(values, [100 * p for p in at.values()]).tolist(), rel=1e-12), g
    assert got["wide"][0] == -1.7e308 and got["wide"][2] == 0.0
    stats = {r.g: r for r in metrics.value_table(df.filter("g <> 'wide'"), ["g"], "v", task_values=task_values, ranges=ranges).collect()}
    assert stats["even"].p95 == pytest.approx(np.percentile(groups["even"], 95)) and stats["even"].min == groups["even"].min() and stats["nothing"].p50 is None
    assert metrics.percentiles(df.limit(0), ["g"], "v", at).count() == 0


def test_percentiles_of_a_whole_table(spark):
    df = spark.range(1001).selectExpr("cast(id AS double) AS v")
    assert metrics.percentiles(df, [], "v", {"p": 0.25}, task_values=5, ranges=8).first().p == 250.0
    with pytest.raises(Exception, match="not finite"):
        metrics.percentiles(spark.createDataFrame([(float("nan"),)], "v double"), [], "v", {"p": 0.5}).collect()


def test_merged_states_do_not_cancel(spark):
    rng = np.random.default_rng(2)
    target = 1e9 + rng.normal(size=300)
    pred = target + rng.normal(size=300) * 0.1
    pred[:40] = target[:40]
    rows = [(k % 7, float(p), float(t)) for k, (p, t) in enumerate(zip(pred, target, strict=True))] + [(3, None, 5.0), (3, 5.0, None), (9, None, None)]
    df = spark.createDataFrame(rows, "part int, p double, t double")
    out = metrics.merged(metrics.mergeable(df, "p", "t", ["part"])).first()
    exact = target - 1e9
    want = 1 - (((pred - target) ** 2).sum()) / ((exact - exact.mean()) ** 2).sum()
    assert out.r2 == pytest.approx(want, rel=1e-6) and out.accuracy == pytest.approx(40 / 300) and out.mae == pytest.approx(np.abs(pred - target).mean())
    by = {r.part: r for r in metrics.merged(metrics.mergeable(df, "p", "t", ["part"]), ["part"]).collect()}
    own = [k for k in range(300) if k % 7 == 2]
    assert by[2].r2 == pytest.approx(1 - ((pred - target)[own] ** 2).sum() / ((exact[own] - exact[own].mean()) ** 2).sum(), rel=1e-6)
    assert (by[9].r2, by[9].mae, by[9].accuracy) == (0, 0, 0)
