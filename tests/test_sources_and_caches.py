"""Archives, identities, caches, logs on disk and packed sets."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from graphloom.functions import features as ft
from graphloom.operators import collate, columns, metrics, runlog
from graphloom.plans import cache
from graphloom.plans.pipeline import Pipeline, hook_order
from graphloom.plans.tasks import AtomicDress, MeanShift
from graphloom.schema import GraphBatch, key_difference
from graphloom.sources import molecules


def test_archives_are_extracted_once(spark, tmp_path):
    header = "gdb {} " + " ".join(["1.0"] * 15)
    with tarfile.open(tmp_path / "x.tar.bz2", "w:bz2") as f:
        for i in (3, 1, 2):
            raw = f"2\n{header.format(i)}\nO 0.0 0.0 0.25 0.1\nXe 1.0 2.*^-6 0.5 0.2\n0".encode()
            info = tarfile.TarInfo(f"set/{i}.xyz")
            info.size = len(raw)
            f.addfile(info, io.BytesIO(raw))
    folder = str(tmp_path / "out")
    assert molecules.extract_archive(str(tmp_path / "x.tar.bz2"), folder) == 3
    (tmp_path / "x.tar.bz2").unlink()
    assert molecules.extract_archive(str(tmp_path / "x.tar.bz2"), folder) == 3
    excluded = spark.createDataFrame([(2,)], "id long")
    atoms = molecules.read_xyz(spark, folder, ["U0"], excluded)
    assert sorted((r.graph_id, r.z_num, r.targets.U0) for r in atoms.collect()) == [(1, 8, 1.0), (1, 54, 1.0), (3, 8, 1.0), (3, 54, 1.0)]


def test_unknown_elements_are_errors(spark):
    rows = spark.createDataFrame([("1\ngdb 1 " + " ".join(["1"] * 15) + "\nXx 0 0 0 0\n",)], "value string")
    with pytest.raises(Exception, match="no element Xx"):
        molecules.parse_xyz(rows).collect()
    assert len(molecules.SYMBOLS) == 118 and molecules.SYMBOLS["Og"] == 118 and molecules.SYMBOLS["Br"] == 35


def test_source_identities(spark):
    assert cache.source_id("qm", "1", 10, ["U0", "gap"]) == "qm:1:total=10:targets=U0+gap" and cache.memory_id("a", 3) == "memory:a:3"
    ids = [spark.createDataFrame([(i,) for i in order], "id long") for order in ((1, 2, 3), (3, 1, 2), (1, 2, 4))]
    a, b, c = (cache.subset_id("s", i, "id") for i in ids)
    assert a == b != c and a.startswith("s:subset=")


def test_run_cached_restores_fitted_tasks(spark):
    df = spark.createDataFrame([(2.0, 2, 0), (7.0, 1, 1), (12.0, 0, 2)], "e double, h int, c int")

    def spec():
        return Pipeline("p").add(AtomicDress([1, 6], "e", ["h", "c"]), "dress").add(MeanShift("e"), "shift").build()

    one, two = spec(), spec()
    first = cache.run_cached(one, df, "memory:x:3")
    assert [round(r.e, 9) + 0.0 for r in first.collect()] == [0.0, 0.0, 0.0]
    again = cache.run_cached(two, df.limit(0), "memory:x:3")
    assert again.count() == 3
    assert two.states()["dress"]["energies"] == pytest.approx({1: 1.0, 6: 6.0})
    other = cache.run_cached(spec(), df, "memory:x:3", fit_source=df.limit(1), fit_key="memory:x:1")
    assert sorted(r.e for r in other.collect())[-1] > 1


def test_collated_batches(spark):
    atoms = spark.createDataFrame([(0, 5, 8), (0, 9, 1), (1, 2, 6), (1, 3, 1), (1, 4, 1), (2, 0, 1)], "graph_id long, atom_id long, z_num int")
    edges = spark.createDataFrame([(0, 5, 9), (1, 2, 3), (1, 4, 2)], "graph_id long, src long, dst long")
    graphs = spark.createDataFrame([(0, 1.5), (1, 2.5), (2, 3.5), (3, 9.0)], "graph_id long, energy double")
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "graph_id long, batch_id long")
    out = collate.collated(GraphBatch(atoms, edges, graphs), members)
    assert sorted((r.batch_id, r["index"], r.graph, r.z_num) for r in out.atoms.collect()) == [(0, 0, 0, 8), (0, 1, 0, 1), (0, 2, 1, 6), (0, 3, 1, 1), (0, 4, 1, 1), (1, 0, 0, 1)]
    assert sorted((r.batch_id, r.src, r.dst) for r in out.edges.collect()) == [(0, 0, 1), (0, 2, 3), (0, 4, 2)]
    assert sorted((r.batch_id, r.position, r.num_atoms, r.energy) for r in out.graphs.collect()) == [(0, 0, 2, 1.5), (0, 1, 3, 2.5), (1, 0, 1, 3.5), (1, 1, 0, 9.0)]
    with pytest.raises(Exception, match="ends at no atom"):
        collate.collated(GraphBatch(atoms, spark.createDataFrame([(0, 5, 77)], edges.schema)), members).edges.collect()
    with pytest.raises(Exception, match="ends at no atom"):
        collate.collated(GraphBatch(atoms, spark.createDataFrame([(0, 77, 5)], edges.schema)), members).edges.collect()
    both = GraphBatch(atoms, edges).concat(GraphBatch(atoms))
    assert both.atoms.count() == 12 and both.edges.count() == 3 and both.graphs is None
    assert both.pipe(lambda b: GraphBatch(b.atoms.limit(1))).atoms.count() == 1
    assert key_difference(atoms, "graph_id", "x") == (["x"], ["atom_id", "z_num"])


def test_running_sums_over_many_partitions(spark):
    rows = [(k % 3 if k % 3 else None, k, float(k * k % 11) if k % 5 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, at long, v double").repartition(7)
    want, sums = {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        s, n = sums.get(g, (None, 0))
        sums[g] = ((s or 0.0) + v, n + 1) if v is not None else (s, n)
        want[at] = sums[g]
    got = {r["at"]: (r.running_sum, r.running_count) for r in collate.running_sums(df, ["g"], ["at"], "v").collect()}
    assert got == want


def test_metrics_csv_on_disk(spark, tmp_path):
    wide = spark.createDataFrame([(1, 0.5, 'a "b", c'), (2, float("nan"), None), (3, None, "x")], "step int, loss double, note string")
    runlog.write_metrics_csv(wide.coalesce(1), ["step", "loss", "note"], str(tmp_path / "m"))
    (file,) = (tmp_path / "m").glob("*.csv")
    assert file.read_text().splitlines() == ["step,loss,note", '1,0.5,"a ""b"", c"', "2,,", "3,,x"]
    lines = [r[0] for r in wide.select(runlog.csv_lines(wide, ["step", "loss", "note"])).collect()]
    assert lines == ['1,0.5,"a ""b"", c"', "2,,", "3,,x"]


def test_small_helpers(spark):
    class Hook:
        def __init__(self, name, priority=None):
            self.name = name
            if priority is not None:
                self.priority = priority

    assert [h.name for h in hook_order([Hook("a"), Hook("b", 5), Hook("c"), Hook("d", 100)])] == ["b", "a", "c", "d"]
    m = ft.random_rotation(3)
    dots = [[sum(m[i][k] * m[j][k] for k in range(3)) for j in range(3)] for i in range(3)]
    assert all(dots[i][j] == pytest.approx(float(i == j)) for i in range(3) for j in range(3)) and m != ft.random_rotation(4)
    with pytest.raises(ValueError):
        ft.rotate_irreps([F.lit(1.0)], "1x1o", m)
    one = spark.createDataFrame([(1.0, (2, "a"))], "x double, s struct<k: int, t: string>")
    assert one.select(columns.nested(one, ("s", "t"))).first()[0] == "a"
    with pytest.raises(KeyError):
        columns.nested(one, ("s", "nope"))
    dense = columns.dense_column(one, ["x"], "y", [([[2.0]], [1.0])], "relu").first()
    assert dense.y == 3.0
    assert one.select(ft.gaussian(F.col("x"), 1.0, 1)[0]).first()[0] == pytest.approx(0.36787944)
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0)], "p double, t double")
    assert metrics.loss(p, "mse", "p", "t", "sum").first().loss == 4.0 and metrics.loss(p, "mae", "p", "t").first().loss == 1.0
    with pytest.raises(ValueError):
        metrics.loss(p, "mae", "p", "t", "max")
    near = spark.range(1, 1001).agg(*metrics.value_stats(F.col("id"), exact=False)).first()
    assert abs(near.p95 - 950) <= 1


def test_streams_of_nothing_and_of_files_that_come_later(spark, tmp_path):
    from graphloom.streaming.metrics import parquet_stream, run_available, summaries

    path = str(tmp_path / "in")
    spark.createDataFrame([], "k string, v double").write.parquet(path)
    assert run_available(summaries(parquet_stream(spark, path), ["k"], "v")).count() == 0
    for rows in ([("a", 1.0), ("b", 2.0)], [("a", 3.0)]):
        spark.createDataFrame(rows, "k string, v double").write.mode("append").parquet(path)
    got = {r.k: (r.n, r.total, r.largest) for r in run_available(summaries(parquet_stream(spark, path), ["k"], "v")).collect()}
    assert got == {"a": (2, 4.0, 3.0), "b": (1, 2.0, 2.0)}
    flat = parquet_stream(spark, path).filter("v > 1")
    assert sorted(r.v for r in run_available(flat, "append").collect()) == [2.0, 3.0]


def test_ids_of_pipelines_hold_what_tasks_do(spark):
    def plus(df):
        return df.withColumn("a", F.col("a") + 1)

    def build(*tasks, name="p"):
        p = Pipeline(name)
        for t in tasks:
            p.add(*t) if isinstance(t, tuple) else p.add(t)
        return p.build().id

    assert build(MeanShift("a"), plus) == build(MeanShift("a"), plus)
    others = [
        build(MeanShift("b"), plus), build(plus, MeanShift("a")), build(MeanShift("a"), (plus, None, "2")), build(MeanShift("a"), plus, name="q"),
        build(AtomicDress([1], "e", ["h"])), build(AtomicDress([6], "e", ["h"])), build(AtomicDress([1, 6], "e", ["h", "c"])), build(AtomicDress([1], "f", ["h"])),
    ]
    assert len({build(MeanShift("a"), plus), *others}) == 9
    fitted = MeanShift("a")
    fitted.mean = 7.0
    assert build(fitted) == build(MeanShift("a"))
    with pytest.raises(ValueError, match="version"):
        build(lambda df: df)
    assert build((lambda df: df, "same", "1")) != build((lambda df: df, "same", "2"))


def test_caches_of_pipelines_with_other_options_are_apart(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 9.0)], "a double, b double")
    for column, want in (("a", [(-1.0, 5.0), (1.0, 9.0)]), ("b", [(1.0, -2.0), (3.0, 2.0)]), ("a", [(-1.0, 5.0), (1.0, 9.0)])):
        out = cache.run_cached(Pipeline("apart").add(MeanShift(column), "shift").build(), df, "memory:apart:2")
        assert sorted(map(tuple, out.collect())) == want


def test_content_ids(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None), (2, None)], "a int, b array<double>")
    same = df.repartition(3).orderBy(F.desc("a"))
    assert cache.content_id(df) == cache.content_id(same)
    others = [df.distinct(), df.withColumnRenamed("a", "c"), df.withColumn("a", F.col("a") + 1), df.withColumn("b", F.array(F.lit(2.0))), df.withColumn("a", F.col("a").cast("long")), df.limit(0)]
    assert len({cache.content_id(d) for d in [df, *others]}) == 7


def test_targets_go_to_graphs_and_atoms(spark):
    atoms = spark.createDataFrame([(1, 5, 8), (1, 2, 1), (2, 0, 6)], "graph_id long, atom_id long, z_num int")
    samples = spark.createDataFrame([(1, (1.5, [0.1, 0.2])), (2, (2.5, [0.3]))], "graph_id long, targets struct<energy: double, forces: array<double>>")
    out = collate.with_targets(GraphBatch(atoms), samples)
    assert sorted(map(tuple, out.atoms.collect())) == [(1, 2, 1, 0.1), (1, 5, 8, 0.2), (2, 0, 6, 0.3)]
    assert sorted(map(tuple, out.graphs.collect())) == [(1, 1.5), (2, 2.5)]
    for wrong in ([0.1], [0.1, 0.2, 0.3]):
        short = spark.createDataFrame([(1, (1.5, wrong)), (2, (2.5, [0.3]))], samples.schema)
        with pytest.raises(Exception, match="as many targets as atoms: graph 1"):
            collate.with_targets(GraphBatch(atoms), short).atoms.collect()


def test_written_sets_and_filled_logs(spark):
    df = spark.range(5)
    _, path = cache.written(df, "set")
    kept = cache.dataset(spark, path, in_memory=True)
    assert kept.storageLevel.useMemory and sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4] == sorted(r.id for r in cache.dataset(spark, path).collect())
    kept.unpersist()
    long = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "step long, key string, value double")
    rows = runlog.logged_metrics(long, ["a", "b"], missing=float("nan")).orderBy("step").collect()
    assert (rows[0].a, rows[1].b) == (2.0, 3.0) and rows[0].b != rows[0].b and rows[1].a != rows[1].a


def test_rows_of_a_stream_are_routed(spark, tmp_path):
    from graphloom.streaming.metrics import routed, windowed_speed

    spark.range(20).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS sink", "timestamp_seconds(id * 60) AS ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, sink string, ts timestamp").parquet(f"{tmp_path}/in")
    routed(stream.select("id", "sink"), "sink", f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/sink=a").count() == 7 and spark.read.parquet(f"{tmp_path}/out").count() == 20
    assert "EventTimeWatermark" in windowed_speed(stream, "ts", "5 minutes", "1 minute")._jdf.queryExecution().toString()


def test_tables_left_behind_can_be_dropped(spark):
    df = spark.range(20).selectExpr("id % 3 AS g", "id AS k", "id * 1.0D AS v")
    with cache.noted() as outer:
        with cache.noted() as paths:
            best = runlog.best_so_far(df, ["g"], ["k"], "v", "max")
            sums = collate.running_sums(df, ["g"], ["k"], "v")
        collate.numbered(df, ["k"])
    assert best.filter("best").count() == 20 and sums.count() == 20 and len(paths) == 2 and outer[:2] == paths and len(outer) == 3
    for path in outer:
        assert cache.is_ready(spark, path)
        cache.drop_written(spark, path)
        assert not cache.is_ready(spark, path)
    cache.written(df, "later")
    assert len(outer) == 3
