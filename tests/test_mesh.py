"""Mesh sums in wave space: both ways of the transform, forces and stress against finite differences."""

import numpy as np
import pytest

from graphloom.operators import mesh as M

CELL = [[2.0, 0.0, 0.0], [0.3, 2.2, 0.0], [-0.2, 0.4, 1.9]]
DDL = "graph_id long, atom_id long, x double, y double, z double, q double"


def placed(n=9, seed=1, graph=3):
    rng = np.random.default_rng(seed)
    return rng.uniform(-1, 3, (n, 3)), rng.normal(size=n), graph


def frame(spark, *graphs):
    return spark.createDataFrame([(g, i, *map(float, p), float(q)) for pos, charge, g in graphs for i, (p, q) in enumerate(zip(pos, charge, strict=True))], DDL)


def energy(pos, q, mesh):
    """The mesh energy of one graph in plain numpy."""
    grid, base, frac = mesh.grid, *mesh.places(pos)
    points = np.zeros((grid,) * 3)
    for n in range(len(q)):
        w = [M.spline_weights(frac[n, k : k + 1], mesh.order)[0] for k in range(3)]
        at = [(base[n, k] + np.arange(mesh.order)) % grid for k in range(3)]
        points[np.ix_(*at)] += q[n] * np.einsum("i,j,k->ijk", *w)
    f, every = np.fft.fftn(points), np.arange(grid)
    m = np.fft.fftfreq(grid, 1 / grid)
    total = 0.0
    for a in every:
        waves = np.stack(np.meshgrid([m[a]], m, m, indexing="ij"), axis=-1) @ mesh.inverse.T
        k2 = (waves**2).sum(-1)
        k2[k2 == 0] = np.inf
        weight = np.exp(-(np.pi**2) * np.where(np.isinf(k2), 0, k2) / mesh.alpha**2) / (np.pi * mesh.volume * k2)
        total += 0.5 * mesh.coulomb * (weight * np.abs(f[a][None]) ** 2 / (mesh.modulus[a] * mesh.modulus[None, :, None] * mesh.modulus[None, None, :])).sum()
    return total


def test_slopes_of_splines():
    x = np.linspace(0.05, 0.9, 7)
    for order in (3, 4, 5, 6):
        want = (M.spline_weights(x + 1e-6, order) - M.spline_weights(x - 1e-6, order)) / 2e-6
        assert np.allclose(M.spline_slopes(x, order), want, atol=1e-7)
    with pytest.raises(ValueError):
        M.Mesh(CELL, 1.0, 8, 2, 1.0)


@pytest.mark.parametrize("grid,whole", [(12, 32), (12, 0), (21, 0), (40, 32)])
def test_energy_forces_and_stress(spark, monkeypatch, grid, whole):
    monkeypatch.setattr(M, "WHOLE", whole)
    if whole == 0:
        monkeypatch.setattr(M, "BLOCK", 5)
        monkeypatch.setattr(M, "TILE", 4)
        monkeypatch.setattr(M, "PACKED_ATOMS", 2)
    kwargs = {"box": CELL, "alpha": 1.7, "grid": grid, "order": 5, "coulomb": 1.3}
    mesh = M.Mesh(CELL, 1.7, grid, 5, 1.3)
    graphs = [placed(), placed(5, 2, 8)]
    atoms = frame(spark, *graphs)
    want = {g: energy(p, q, mesh) for p, q, g in graphs}
    assert {r.graph_id: r.energy for r in M.ewald_reciprocal(atoms, **kwargs).collect()} == pytest.approx(want, rel=1e-10)
    got = {(r.graph_id, r.atom_id): (r.fx, r.fy, r.fz) for r in M.ewald_reciprocal_forces(atoms, **kwargs).collect()}
    assert len(got) == 14
    pos, q, g = graphs[0]
    for i, a in ((0, 0), (3, 1), (8, 2)):
        up, down = pos.copy(), pos.copy()
        up[i, a] += 1e-5
        down[i, a] -= 1e-5
        assert got[g, i][a] == pytest.approx(-(energy(up, q, mesh) - energy(down, q, mesh)) / 2e-5, rel=1e-6, abs=1e-8)
    stress = {r.graph_id: r for r in M.ewald_reciprocal_stress(atoms, **kwargs).collect()}
    for a, b, name in ((0, 0, "xx"), (2, 2, "zz"), (0, 1, "xy"), (1, 2, "yz")):
        strained = []
        for e in (1e-5, -1e-5):
            strain = np.eye(3)
            strain[a, b] += e / 2
            strain[b, a] += e / 2
            moved = np.array(CELL) @ strain
            strained.append(energy(pos @ strain, q, M.Mesh(moved.tolist(), 1.7, grid, 5, 1.3)))
        assert stress[g][name] == pytest.approx((strained[0] - strained[1]) / 2e-5 / mesh.volume, rel=1e-6, abs=1e-8)


def test_a_large_mesh_has_small_groups(spark):
    atoms = frame(spark, placed(40))
    mesh = M.Mesh(CELL, 1.7, 128, 4, 1.0)
    pieces = M._transformed(M._spread(atoms, mesh), mesh)
    sizes = pieces.selectExpr("graph_id", "a", "b", "length(data) AS n").groupBy("graph_id", "a", "b").sum("n").collect()
    assert len(sizes) == 8 * 5 and max(r["sum(n)"] for r in sizes) <= 16 * 128 * M.BLOCK**2
    small = M.ewald_reciprocal(atoms, box=CELL, alpha=1.7, grid=32, order=6).first().energy
    assert M.ewald_reciprocal(atoms, box=CELL, alpha=1.7, grid=128, order=4).first().energy == pytest.approx(small, rel=1e-3)


def test_no_atoms_and_missing_ids(spark):
    none = frame(spark, placed()).limit(0)
    assert M.ewald_reciprocal(none, box=CELL, alpha=1.0).count() == 0 and M.ewald_reciprocal_forces(none, box=CELL, alpha=1.0).count() == 0
    with pytest.raises(Exception, match="without graph_id"):
        M.ewald_reciprocal(spark.createDataFrame([(None, 1, 0.0, 0.0, 0.0, 1.0)], DDL), box=CELL, alpha=1.0).collect()
