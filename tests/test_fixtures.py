"""Small value fixtures and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import features as ft
from graphloom.functions import physics as ph
from graphloom.operators import collate, metrics, neighbors, pooling
from graphloom.operators.encoders import edge_encoder, node_encoder
from graphloom.operators.kernels import polarization
from graphloom.operators.mesh import ewald_reciprocal
from graphloom.plans.cache import cache_key, classify
from graphloom.plans.pipeline import Pipeline
from graphloom.plans.tasks import AtomicDress, MeanShift
from graphloom.schema import flatten_columns, nest_atoms, require, unflatten_columns, unnest_atoms
from graphloom.sources.molecules import exclusion_ids, mock_molecules, parse_xyz, register


def atoms(spark, rows, g=0):
    return spark.createDataFrame([(g, k, z, *map(float, p)) for k, (z, p) in enumerate(rows)], "graph_id long, atom_id long, z_num int, x double, y double, z double")


def test_three_atoms(spark):
    a = atoms(spark, [(8, (0, 0, 0)), (1, (1, 0, 0)), (1, (0, 1, 0))])
    half = neighbors.neighbor_pairs(a, 2.0)
    assert sorted(round(r.dist, 6) for r in half.collect()) == [1.0, 1.0, round(math.sqrt(2), 6)]
    full = neighbors.directed_edges(half)
    rows = full.join(a.select(F.col("atom_id").alias("src"), "x"), "src").collect()
    assert len(rows) == 6
    one = full.filter("src = 0 AND dst = 1").first()
    assert (one.dx, one.dy, one.dz) == (1.0, 0.0, 0.0)


def test_cutoff_is_inclusive_or_not(spark):
    a = atoms(spark, [(1, (0, 0, 0)), (1, (1, 0, 0)), (1, (3, 0, 0))])
    assert neighbors.neighbor_pairs(a, 2.0).count() == 2
    assert neighbors.neighbor_pairs(a, 2.0, inclusive=False).count() == 1


def test_coincident_atoms_and_single_atoms_have_no_pair(spark):
    assert neighbors.neighbor_pairs(atoms(spark, [(1, (0, 0, 0)), (1, (0, 0, 0))]), 1.0).count() == 0
    assert neighbors.neighbor_pairs(atoms(spark, [(1, (0, 0, 0))]), 1.0).count() == 0


@pytest.mark.parametrize("cutoff", [0.7, 1.3])
def test_cells_agree_with_simple_join(spark, cutoff):
    a = mock_molecules(spark, 20, 5, 30)
    key = lambda df: sorted((r.graph_id, r.i, r.j) for r in df.collect())
    assert key(neighbors.neighbor_pairs(a, cutoff)) == key(neighbors.neighbor_pairs_simple(a, cutoff))


def test_minimum_image_rounds_halves_to_even(spark):
    d = spark.range(1).select(*[c.alias(n) for n, c in zip("xyz", neighbors.minimum_image(F.lit(0.5), F.lit(1.5), F.lit(0.0), [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]), strict=True)])
    assert tuple(d.first()) == (0.5, -0.5, 0.0)


def test_unknown_element_is_an_error(spark):
    a = atoms(spark, [(99, (0, 0, 0))])
    table = spark.createDataFrame([(1, 2.0)], "z_num int, p double")
    with pytest.raises(Exception, match="no parameters"):
        neighbors.lookup(a, table).collect()


def test_edge_to_node(spark):
    e = spark.createDataFrame([(0, 0, 1, 0.0, 1.0), (0, 1, 0, 2.0, 3.0), (0, 1, 2, 4.0, 5.0), (0, 2, 1, 6.0, 7.0)], "graph_id long, src long, dst long, f double, g double")
    a = atoms(spark, [(1, (0, 0, 0))] * 4)
    got = {r.atom_id: (r.f, r.g) for r in pooling.edge_to_node(e, a, ["f", "g"], "sum").collect()}
    assert got == {0: (2, 3), 1: (6, 8), 2: (4, 5), 3: (0, 0)}
    got = {r.atom_id: (r.f, r.g) for r in pooling.edge_to_node(e, a, ["f", "g"], "mean").collect()}
    assert got == {0: (2, 3), 1: (3, 4), 2: (4, 5), 3: (0, 0)}
    with pytest.raises(ValueError):
        pooling.edge_to_node(e, a, ["f"], "max")


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 5.0)], "p double, t double")
    row = metrics.evaluate(df, ["mae", "mse", "rmse", "r2"], "p", "t").first()
    assert row.mse == pytest.approx(5 / 3) and row.rmse == pytest.approx(math.sqrt(5 / 3)) and row.mae == pytest.approx(1)
    assert row.r2 == pytest.approx(1 - 5 / 8)
    empty = metrics.evaluate(df.limit(0), ["mae", "mse", "rmse", "r2", "accuracy"], "p", "t").first()
    assert tuple(empty) == (0.0,) * 5
    flat = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "p double, t double")
    assert metrics.evaluate(flat, ["r2"], "p", "t").first().r2 == 0
    acc = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "p int, t int")
    assert metrics.evaluate(acc, ["accuracy"], "p", "t").first().accuracy == 0.5


def test_atomic_dress(spark):
    df = spark.createDataFrame([(2, 0, 2.0), (1, 1, 7.0), (0, 2, 12.0)], "h int, c int, u double")
    task = AtomicDress(elements=[1, 6], target="u", counts=["h", "c"])
    task.fit(df)
    assert task.energies == pytest.approx({1: 1.0, 6: 6.0})
    assert all(abs(r.u) < 1e-9 for r in task.apply(df).collect())


def test_pipeline_fits_on_the_given_source(spark):
    df = spark.createDataFrame([(float(k),) for k in range(8)], "y double")
    spec = Pipeline("p").add(MeanShift("y"), "shift").build()
    out = spec.run(df, fit_source=df.filter("y < 2"))
    assert spec.states() == {"shift": {"mean": 0.5}}
    assert sorted(r.y for r in out.collect()) == [k - 0.5 for k in range(8)]
    again = Pipeline("p").add(MeanShift("y"), "shift").build()
    again.load({"shift": {"mean": 1.0}, "other": {}})
    assert again.transform(df).agg(F.sum("y")).first()[0] == 28 - 8
    with pytest.raises(TypeError):
        Pipeline("p").add(3)


def test_collate_and_split(spark):
    g = spark.createDataFrame([(0, 10, 2), (0, 11, 3), (1, 12, 4)], "batch_id int, graph_id long, num_atoms long")
    got = {r.graph_id: (r.atom_offset, r.position) for r in collate.collate_offsets(g).collect()}
    assert got == {10: (0, 0), 11: (2, 1), 12: (0, 0)}
    with pytest.raises(ValueError):
        collate.split(g, "graph_id", sizes=(1, 1))
    parts = [r.part for r in collate.split(g, "graph_id", sizes=(2, 1)).collect()]
    assert sorted(parts) == ["train", "train", "val"]


def test_cache_key_and_levels(spark):
    assert cache_key("a", extra={"b": "1", "a": "2"}) == cache_key("a", extra={"a": "2", "b": "1"})
    df = spark.createDataFrame([([1, 2], [1.0]), ([1], [2.0, 3.0])], "z array<int>, odd array<double>")
    with pytest.raises(Exception, match="no level"):
        classify(df, F.size("z"), None, ["z", "odd"]).collect()


def test_nesting_round_trips(spark):
    a = atoms(spark, [(8, (0, 0, 0)), (1, (1, 0, 0))])
    assert sorted(unnest_atoms(nest_atoms(a)).select(*a.columns).collect()) == sorted(a.collect())
    nested = a.select("graph_id", F.struct("x", F.struct("y").alias("deep")).alias("pos"))
    flat = flatten_columns(nested)
    assert flat.columns == ["graph_id", "pos.x", "pos.deep.y"]
    assert unflatten_columns(flat).collect() == nested.collect()
    with pytest.raises(KeyError):
        require(a, "charge")


@pytest.mark.parametrize(
    "energy, slope",
    [
        (lambda r: ph.lennard_jones(r, F.lit(0.3), F.lit(1.1)), lambda r: ph.lennard_jones_slope(r, F.lit(0.3), F.lit(1.1))),
        (lambda r: ph.repulsion(r, F.lit(0.2), F.lit(3.0), F.lit(1.2)), lambda r: ph.repulsion_slope(r, F.lit(0.2), F.lit(3.0), F.lit(1.2))),
        (lambda r: ph.dispersion(r, F.lit(5.0), F.lit(1.2)), lambda r: ph.dispersion_slope(r, F.lit(5.0), F.lit(1.2))),
        (lambda r: ph.charge_transfer(r, F.lit(0.2), F.lit(0.9), F.lit(1.2)), lambda r: ph.charge_transfer_slope(r, F.lit(0.2), F.lit(0.9), F.lit(1.2))),
    ],
)
def test_slopes_are_derivatives(spark, energy, slope):
    h = 1e-5
    df = spark.createDataFrame([(r / 10,) for r in range(8, 30)], "r double")
    rows = df.select(((energy(F.col("r") + h) - energy(F.col("r") - h)) / (2 * h)).alias("n"), slope(F.col("r")).alias("s")).collect()
    assert all(r.s == pytest.approx(r.n, rel=1e-5, abs=1e-7) for r in rows)


def test_erfc(spark):
    df = spark.createDataFrame([(k / 20,) for k in range(121)], "x double")
    assert max(abs(r.e - math.erfc(r.x)) for r in df.select("x", ph.erfc(F.col("x")).alias("e")).collect()) < 2e-7


def test_features(spark):
    row = spark.range(1).select(ft.cosine_cutoff(F.lit(2.0), 2.0).alias("c"), ft.polynomial_cutoff(F.lit(2.0), 2.0).alias("p"), ft.softplus(F.lit(30.0)).alias("s")).first()
    assert tuple(row) == (0.0, 0.0, 30.0)
    mean, std = ft.bessel_statistics(5.0, 3)
    assert len(mean) == len(std) == 3 and all(s > 0 for s in std)
    assert ft.irreps(4, 1) == "4x0e + 4x1o"


def water(spark, g=0):
    a = spark.createDataFrame(
        [(g, 0, 8, 0.0, 0.0, 0.0, -0.8, 1.0), (g, 1, 1, 0.96, 0.0, 0.0, 0.4, 0.5), (g, 2, 1, -0.24, 0.93, 0.0, 0.4, 0.5)],
        "graph_id long, atom_id long, z_num int, x double, y double, z double, q double, alpha double",
    )
    return a, neighbors.directed_edges(neighbors.neighbor_pairs(a, 5.0))


def test_polarization(spark):
    a, e = water(spark)
    assert polarization(a, e).first().energy < 0
    assert polarization(a.withColumn("q", F.lit(0.0)), e).first().energy == 0
    b, f = water(spark, 1)
    rows = polarization(a.union(b), e.union(f)).collect()
    assert rows[0].energy == pytest.approx(rows[1].energy)


def test_reciprocal_energy_does_not_depend_on_the_origin(spark):
    a, _ = water(spark)
    one = ewald_reciprocal(a, box=(8.0, 8.0, 8.0), alpha=0.6, grid=32).first().energy
    two = ewald_reciprocal(a.withColumn("x", F.col("x") + 1.37), box=(8.0, 8.0, 8.0), alpha=0.6, grid=32).first().energy
    assert one > 0 and two == pytest.approx(one, rel=1e-3)


@pytest.mark.parametrize("encoder, key", [(node_encoder, "atom_id"), (edge_encoder, "dst")])
def test_encoders_do_not_depend_on_orientation(spark, encoder, key):
    a = mock_molecules(spark, 2, 5, 8)
    m = ft.axis_rotation("x", 0.9)
    x, y, z = ft.rotate(F.col("x"), F.col("y"), F.col("z"), m)
    turned = a.select("graph_id", "atom_id", "z_num", (x + 3).alias("x"), y.alias("y"), (z - 1).alias("z"))
    kinds = [1, 6, 7, 8, 9]

    def rows(t):
        e = neighbors.directed_edges(neighbors.neighbor_pairs(t, 3.0))
        out = encoder(t, e, cutoff=3.0, species=kinds)
        order = [c for c in ("graph_id", "src", key) if c in out.columns]
        return [r.features for r in out.orderBy(*order).collect()]

    for p, q in zip(rows(a), rows(turned), strict=True):
        assert p == pytest.approx(q, rel=1e-7, abs=1e-8)


def test_sources(spark, tmp_path):
    import numpy as np

    register(spark)
    np.savez(tmp_path / "m.npz", nuclear_charges=[8, 1], coords=np.arange(18.0).reshape(3, 2, 3), energies=[1.0, 2.0, 3.0], forces=np.zeros((3, 2, 3)))
    df = spark.read.format("npz_frames").option("paths", str(tmp_path / "m.npz")).option("frames_per_partition", "2").load()
    assert df.count() == 6 and df.filter("frame = 2 AND atom_id = 1").first().x == 15.0
    (tmp_path / "a.xyz").write_text("2\nenergy=-1.5 pbc=F\nH 0 0 0 1 2 3\nO 1 1 1 0 0 0\n1\nenergy=2\nC 0 0 1 0 0 0\n")
    df = spark.read.format("extxyz").option("paths", str(tmp_path / "a.xyz")).load()
    assert [(r.frame, r.z_num, r.energy) for r in df.orderBy("frame", "atom_id").collect()] == [(0, 1, -1.5), (0, 8, -1.5), (1, 6, 2.0)]
    with pytest.raises(Exception, match="no files"):
        spark.read.format("npz_frames").load().count()
    with pytest.raises(ValueError):
        parse_xyz(df, "file", targets=["nothing"])
    text = "\n".join([*(f"h{k}" for k in range(9)), "7 x", "end"])
    assert [r.id for r in exclusion_ids(spark.createDataFrame([(text,)], "value string")).collect()] == [7]


def test_harmonics_add_up(spark):
    df = spark.createDataFrame([(0.6, 0.0, 0.8), (0.36, 0.48, 0.8), (-1.0, 0.0, 0.0)], "x double, y double, z double")
    s = ft.spherical_harmonics(F.col("x"), F.col("y"), F.col("z"), 3)
    for row in df.select(*[c.alias(f"s{k}") for k, c in enumerate(s)]).collect():
        for l in range(4):
            assert sum(v * v for v in row[l * l : (l + 1) ** 2]) == pytest.approx((2 * l + 1) / (4 * math.pi))
    with pytest.raises(ValueError):
        ft.spherical_harmonics(F.col("x"), F.col("y"), F.col("z"), 4)
