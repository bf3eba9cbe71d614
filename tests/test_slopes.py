"""Forces of induced dipoles and stress of bonded terms against finite differences, and joins that tell what they miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import physics as ph
from graphloom.operators import columns, kernels, neighbors, pooling, potentials
from test_physics_exact import dense_polarization, tables


@pytest.mark.parametrize("task_rows", [kernels.TASK_ROWS, 0])
def test_polarization_forces(spark, task_rows):
    rng = np.random.default_rng(4)
    pos, q, alpha = rng.normal(size=(6, 3)) * 1.5, rng.normal(size=6), rng.uniform(0.3, 0.9, 6)
    atoms, edges = tables(spark, {2: (pos, q, alpha), 5: (pos[:2] * 2, q[:2], alpha[:2])})
    out = kernels.polarization_forces(atoms, edges, task_rows=task_rows)
    got = {(r.graph_id, r.atom_id): (r.fx, r.fy, r.fz) for r in out.collect()}
    assert len(got) == 8 and len(out.written_to) == 1
    for i, a in ((0, 0), (2, 1), (5, 2)):
        up, down = pos.copy(), pos.copy()
        up[i, a] += 1e-5
        down[i, a] -= 1e-5
        assert got[2, i][a] == pytest.approx(-(dense_polarization(up, q, alpha) - dense_polarization(down, q, alpha)) / 2e-5, rel=1e-5, abs=1e-7)
    assert np.sum([v for (g, _), v in got.items() if g == 2], axis=0) == pytest.approx([0, 0, 0], abs=1e-9)


@pytest.mark.parametrize("task_rows", [kernels.TASK_ROWS, 0])
def test_both_solves_have_one_answer(spark, task_rows):
    pos, q = np.array([[0.0, 0, 0], [1.2, 0, 0], [0, 1.5, 0.3]]), [1.0, -0.5, 0.7]
    atoms, edges = tables(spark, {0: (pos, q, [0.5, 0.0, 0.4])})
    got = kernels.polarization(atoms, edges, task_rows=task_rows).first().energy
    assert got == pytest.approx(dense_polarization(pos, q, [0.5, kernels.LEAST_ALPHA, 0.4]), rel=1e-8)
    with pytest.raises(Exception, match="no atom"):
        kernels.polarization(atoms.filter("atom_id < 2"), edges, task_rows=task_rows).collect()
    with pytest.raises(Exception, match="no atom"):
        kernels.polarization(atoms.limit(0), edges, task_rows=task_rows).collect()


@pytest.mark.parametrize("what,chain", [("bond", (0, 1)), ("angle", (0, 1, 2)), ("dihedral", (0, 1, 2, 3))])
def test_bonded_stress(spark, what, chain):
    pos = np.array([[0.0, 0.1, 0], [1.1, 0.2, -0.1], [1.4, 1.2, 0.3], [0.6, 1.5, 1.2]])
    kinds = spark.createDataFrame([(1, 3.0, 0.8)], "kind int, k double, x0 double")
    top = spark.createDataFrame([(7, *chain, 1)], "graph_id long, " + ", ".join(f"a{k + 1} long" for k in range(len(chain))) + ", kind int")

    def atoms(p):
        return spark.createDataFrame([(7, i, *map(float, x)) for i, x in enumerate(p)], "graph_id long, atom_id long, x double, y double, z double")

    got = potentials.bonded_stress(atoms(pos), top, kinds, what, 2.0).first()
    for a, b, name in ((0, 0, "xx"), (1, 2, "yz"), (0, 1, "xy")):
        energies = []
        for e in (1e-5, -1e-5):
            strain = np.eye(3)
            strain[a, b] += e / 2
            strain[b, a] += e / 2
            energies.append(potentials.bonded_energy(atoms(pos @ strain), top, kinds, what).first().energy)
        assert got[name] == pytest.approx((energies[0] - energies[1]) / 2e-5 / 2.0, rel=1e-4, abs=1e-6)


ATOMS, EDGES = [(0, 1, 1, 0.0, 0.0, 0.0), (0, 2, 6, 1.0, 0.0, 0.0)], [(0, 1, 2, 1.0, 0.0, 0.0, 1.0), (0, 2, 9, -1.0, 0.0, 0.0, 1.0)]


def test_joins_tell_what_they_miss(spark):
    atoms = spark.createDataFrame(ATOMS, "graph_id long, atom_id long, z_num int, x double, y double, z double")
    edges = spark.createDataFrame(EDGES, "graph_id long, src long, dst long, dx double, dy double, dz double, dist double")
    pairs = spark.createDataFrame([(0, 2, 1, 1.0), (0, 9, 1, 1.0)], "graph_id long, i long, j long, dist double").selectExpr("graph_id", "i", "j", "dist AS dx", "0D AS dy", "0D AS dz", "dist")
    assert neighbors.with_ends(edges.limit(1), atoms, "z_num").select("z_num_src", "z_num_dst").collect() == [(1, 6)]
    top = spark.createDataFrame([(0, 1, 2, 0), (0, 1, 9, 0), (0, 2, 1, 5)], "graph_id long, a1 long, a2 long, kind int")
    kinds, table = spark.createDataFrame([(0, 1.0, 0.5)], "kind int, k double, x0 double"), spark.createDataFrame([(1, 0.5)], "z_num int, e0 double")
    params = atoms.withColumn("c6", F.lit(1.0))
    cases = [
        (neighbors.with_ends(edges, atoms, "z_num"), "no atom"),
        (neighbors.with_ends(edges, atoms, "z_num").select("graph_id", "z_num_src", "z_num_dst"), "no atom"),
        (pooling.messages(edges.selectExpr("graph_id", "dst AS src", "src AS dst", "dx", "dy", "dz", "dist"), atoms, {"m": "x"}, F.lit(1.0)), "no atom"),
        (potentials.mix_pairs(pairs, params, geometric=["c6"]), "no atom"),
        (potentials.placed_pairs(pairs.select("graph_id", "i", "j"), atoms), "no atom"),
        (potentials.bonded_energy(atoms, top.filter("kind = 0"), kinds, "bond"), "not there"),
        (potentials.bonded_energy(atoms, top.filter("kind = 5"), kinds, "bond"), "unknown kind"),
        (columns.joint_embedding(atoms, "z_num", table, [F.col("x")], [([1.0, 1.0], 0.0)], ["h"]), "no embedding for: 6"),
    ]
    for df, message in cases:
        with pytest.raises(Exception, match=message):
            df.collect()
    assert ph.R_MIN > 0
