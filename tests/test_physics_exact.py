"""Polarization, forces and neighbor lists against independent dense versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.functions import physics as ph
from graphloom.operators import kernels, mesh, neighbors, pooling, potentials

WATER = ([(0, 0, 0), (0.96, 0, 0), (-0.24, 0.93, 0)], [-0.8, 0.4, 0.4], [1.0, 0.5, 0.5])


def dense_polarization(pos, q, alpha, thole=0.39):
    """One matrix for all dipoles of a graph in which every pair is an edge."""
    pos, q, alpha = (np.array(x, float) for x in (pos, q, alpha))
    n = len(q)
    field, whole = np.zeros((n, 3)), np.zeros((3 * n, 3 * n))
    for i in range(n):
        whole[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] = np.eye(3) / alpha[i]
        for j in range(n):
            if i != j:
                d = pos[j] - pos[i]
                r = np.linalg.norm(d)
                field[i] += q[j] * d / r / r
                u = thole * r / (alpha[i] * alpha[j]) ** (1 / 6)
                damped = (1 - (1 + u + u * u / 2) * math.exp(-u)) / r**3
                whole[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] -= damped * (3 * np.outer(d, d) / r**2 - np.eye(3))
    return -0.5 * float(np.linalg.solve(whole, field.ravel()) @ field.ravel())


def tables(spark, graphs):
    atoms = [(g, i, *map(float, p), float(q), float(a)) for g, (pos, qs, alphas) in graphs.items() for i, (p, q, a) in enumerate(zip(pos, qs, alphas, strict=True))]
    edges = []
    for g, (pos, _, _) in graphs.items():
        for i, p in enumerate(pos):
            for j, o in enumerate(pos):
                if i != j:
                    d = np.array(o, float) - np.array(p, float)
                    edges.append((g, i, j, *map(float, d), float(np.linalg.norm(d))))
    return (
        spark.createDataFrame(atoms, "graph_id long, atom_id long, x double, y double, z double, q double, alpha double"),
        spark.createDataFrame(edges, "graph_id long, src long, dst long, dx double, dy double, dz double, dist double"),
    )


@pytest.mark.parametrize("task_rows", [kernels.TASK_ROWS, 0])
def test_polarization_matches_a_dense_solve(spark, task_rows):
    rng = np.random.default_rng(5)
    graphs = {0: WATER}
    for g in range(1, 11 if task_rows else 3):
        n = int(rng.integers(2, 9))
        graphs[g] = (rng.normal(size=(n, 3)) * 2, rng.normal(size=n), rng.uniform(0.3, 1.0, n))
    atoms, edges = tables(spark, graphs)
    rows = kernels.polarization(atoms, edges, task_rows=task_rows).collect()
    got = {r.graph_id: r.energy for r in rows}
    assert got[0] == pytest.approx(-0.34013, abs=1e-5)
    assert got == pytest.approx({g: dense_polarization(*x) for g, x in graphs.items()}, abs=1e-6)
    assert all(r.residual < 1e-9 for r in rows)


def test_polarization_tells_of_a_solve_that_did_not_end(spark):
    atoms, edges = tables(spark, {0: WATER})
    assert kernels.polarization(atoms, edges, max_steps=1).first().residual > 1e-6
    empty = kernels.polarization(atoms.withColumn("q", F.lit(0.0)), edges).first()
    assert (empty.energy, empty.residual) == (0.0, 0.0)


def test_scatter_sum_of_the_smallest_index(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 3.0)], "index long, value double")
    assert [tuple(r) for r in pooling.scatter_sum(df, "index", "value").collect()] == [(0, 5.0)]
    assert pooling.scatter_sum(df.limit(0), "index", "value").count() == 0


POINTS = {1: (0.1, 0.2, -0.3), 2: (1.2, 0.1, 0.2), 3: (1.9, 1.3, -0.1), 4: (2.8, 1.1, 1.2), 5: (9.0, 9.0, 9.0)}


@pytest.mark.parametrize("what", ["bond", "angle", "dihedral"])
def test_bonded_forces_are_slopes_of_the_energy(spark, what):
    n, h = potentials.BONDED[what][0], 1e-5
    moved = [(g, i, *p) for g, i0, a, s in [(0, 0, 0, 0.0)] + [(1 + 6 * (i - 1) + 2 * a + k, i, a, s) for i in range(1, 5) for a in range(3) for k, s in ((0, h), (1, -h))]
             for i, xyz in POINTS.items() for p in [[v + (s if i == i0 and c == a else 0.0) for c, v in enumerate(xyz)]]]
    atoms = spark.createDataFrame(moved, "graph_id long, atom_id long, x double, y double, z double")
    kinds = spark.createDataFrame([(0, 3.0, 0.4)], "kind int, k double, x0 double")
    ids = ", ".join(f"{k} as a{k}" for k in range(1, n + 1))
    topology = atoms.select("graph_id").distinct().selectExpr("graph_id", *[f"cast({p.split(' as ')[0]} as long) as {p.split(' as ')[1]}" for p in ids.split(", ")], "0 as kind")
    energy = {r.graph_id: r.energy for r in potentials.bonded_energy(atoms, topology, kinds, what).collect()}
    force = {r.atom_id: (r.fx, r.fy, r.fz) for r in potentials.bonded_forces(atoms, topology, kinds, what).filter("graph_id = 0").collect()}
    for i in range(1, 5):
        want = [-(energy[1 + 6 * (i - 1) + 2 * a] - energy[2 + 6 * (i - 1) + 2 * a]) / (2 * h) for a in range(3)]
        assert force[i] == pytest.approx(want, abs=1e-5)
    assert force[5] == (0.0, 0.0, 0.0)


def test_composed_forces_are_slopes_of_the_energy(spark):
    h, names = 1e-6, ["lj", "dispersion"]
    d, eps, sigma, c6, rs = (F.col(c) for c in ("dist", "eps", "sigma", "c6", "r_star"))
    parts = {"lj": (ph.lennard_jones(d, eps, sigma), ph.lennard_jones_slope(d, eps, sigma)), "dispersion": (ph.dispersion(d, c6, rs), ph.dispersion_slope(d, c6, rs))}
    rows = [(g, i, x + (s if i == 2 else 0.0), 0.3 * i, 0.0, 0.5 + 0.1 * i, 1.0, 5.0, 1.5) for g, s in ((0, 0.0), (1, h), (2, -h)) for i, x in ((1, 0.0), (2, 1.1), (3, 2.5))]
    atoms = spark.createDataFrame(rows, "graph_id long, atom_id long, x double, y double, z double, eps double, sigma double, c6 double, r_star double")
    pairs = potentials.placed_pairs(spark.createDataFrame([(g, i, j) for g in range(3) for i, j in ((2, 1), (3, 1), (3, 2))], "graph_id long, i long, j long"), atoms)
    mixed = potentials.mix_pairs(pairs, atoms, geometric=["eps", "c6"], arithmetic=["sigma", "r_star"])
    energies, force = potentials.compose_forces(mixed, parts, atoms)
    total = {r.graph_id: r.total for r in energies.collect()}
    own = force.filter("graph_id = 0").collect()
    assert next(r.fx for r in own if r.atom_id == 2) == pytest.approx(-(total[1] - total[2]) / (2 * h), abs=1e-4)
    assert sum(r.fx for r in own) == pytest.approx(0, abs=1e-12) and set(names) < set(energies.columns)
    with pytest.raises(ValueError):
        potentials.compose_forces(mixed, {}, atoms)


def plain_periodic(pos, cell, cutoff):
    out = set()
    for i in range(len(pos)):
        for j in range(i):
            d = np.array(pos[i]) - np.array(pos[j])
            for k in (2, 1, 0):
                d = d - np.rint(d[k] / cell[k][k]) * np.array(cell[k])
            if 0 < d @ d <= cutoff * cutoff:
                out.add((i, j))
    return out


@pytest.mark.parametrize("cell", [[[4.0, 0, 0], [1.5, 4.0, 0], [-1.0, 1.9, 4.5]], [[9.0, 0, 0], [0, 2.2, 0], [0, 0, 6.0]], [[2.0, 0, 0], [0, 2.0, 0], [0, 0, 2.0]], [[3.0, 0, 0], [0, 3.0, 0], [0, 0, 3.0]]])
def test_periodic_list_by_bins(spark, cell):
    rng = np.random.default_rng(8)
    pos = [tuple(map(float, p)) for p in rng.uniform(-9, 9, size=(150, 3))] + [(0.0, 0.0, 0.0), (cell[0][0], 0.0, 0.0), (1.0, 0.0, 0.0)]
    atoms = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pos)], "graph_id long, atom_id long, x double, y double, z double")
    got = {(r.i, r.j) for r in neighbors.neighbor_pairs_periodic(atoms, 1.0, cell).collect()}
    assert got == plain_periodic(pos, cell, 1.0)


def test_neighbor_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    pos = rng.uniform(-2, 2, size=(120, 3)).round(1)
    atoms = spark.createDataFrame([(1, int(i) * 7 % 120, *map(float, p)) for i, p in enumerate(pos)], "graph_id long, atom_id long, x double, y double, z double")
    one = neighbors.neighbor_pairs(atoms, 0.7).toPandas().sort_values(["i", "j"]).reset_index(drop=True)
    two = neighbors.neighbor_pairs_simple(atoms, 0.7).toPandas().sort_values(["i", "j"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, two)
    assert (one["i"] > one["j"]).all() and len(one) > 100
    edges = neighbors.directed_edges(neighbors.neighbor_pairs(atoms, 0.7))
    assert edges.count() == 2 * len(one) and edges.filter("dx * dx + dy * dy + dz * dz > 0.491").count() == 0


@pytest.mark.parametrize("box", [(3.0, 4.0, 3.5), [[3.0, 0, 0], [0.8, 3.5, 0], [-0.6, 1.1, 4.0]]])
def test_reciprocal_energy_matches_a_sum_over_waves(spark, box):
    rng = np.random.default_rng(6)
    pos, q = rng.uniform(-5, 5, size=(9, 3)), rng.normal(size=9)
    cell, alpha = mesh.cell_of(box), 1.1
    inverse, volume, total = np.linalg.inv(cell), abs(np.linalg.det(cell)), 0.0
    n = range(-8, 9)
    for m in ((a, b, c) for a in n for b in n for c in n if (a, b, c) != (0, 0, 0)):
        wave = np.array(m) @ inverse.T
        k2 = wave @ wave
        total += math.exp(-(math.pi**2) * k2 / alpha**2) / k2 * abs(np.sum(q * np.exp(2j * math.pi * (pos @ wave)))) ** 2
    atoms = spark.createDataFrame([(0, i, *map(float, p), float(c)) for i, (p, c) in enumerate(zip(pos, q, strict=True))], "graph_id long, atom_id long, x double, y double, z double, q double")
    got = mesh.ewald_reciprocal(atoms, box=box, alpha=alpha, grid=24, order=6).first().energy
    assert got == pytest.approx(total / (2 * math.pi * volume), rel=1e-4)


@pytest.mark.parametrize("name", list(potentials.MIXINGS))
def test_named_potentials(spark, name):
    h, term = 1e-6, potentials.potential(name)
    rows = [(g, i, x + (s if i == 2 else 0.0), 0.3 * i, 0.1, 0.5 + 0.1 * i, 1.0, 5.0 + i, 1.5, 3.0) for g, s in ((0, 0.0), (1, h), (2, -h)) for i, x in ((1, 0.0), (2, 1.1), (3, 2.5))]
    atoms = spark.createDataFrame(rows, "graph_id long, atom_id long, x double, y double, z double, eps double, sigma double, c6 double, r_star double, lam double")
    pairs = potentials.placed_pairs(spark.createDataFrame([(g, i, j) for g in range(3) for i, j in ((2, 1), (3, 1), (3, 2))], "graph_id long, i long, j long"), atoms)
    energy = [term.calc_energy(pairs.filter(F.col("graph_id") == g), atoms) for g in range(3)]
    force = {(r.graph_id, r.atom_id): r.fx for r in term.calc_forces(pairs, atoms).collect()}
    assert force[0, 2] == pytest.approx(-(energy[1] - energy[2]) / (2 * h), rel=1e-4, abs=1e-6)
    assert potentials.mix_for(name, pairs, atoms).count() == 9
