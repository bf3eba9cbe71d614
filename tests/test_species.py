"""Atoms without weights do not vanish."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import equivariant


@pytest.mark.parametrize("z", [7, None])
def test_atoms_without_weights_are_errors(spark, z):
    atoms = spark.createDataFrame([(1, 6, 2.0), (2, z, 3.0)], "atom_id long, z_num int, x double")
    weights = spark.createDataFrame([(6, 0.5)], "z_num int, w0 double")
    out = equivariant.by_species(atoms, weights).select("atom_id", (F.col("x") * F.col("w0")).alias("h"))
    assert [tuple(r) for r in equivariant.by_species(atoms.limit(1), weights).select("atom_id", (F.col("x") * F.col("w0")).alias("h")).collect()] == [(1, 1.0)]
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|no parameters for"):
        out.collect()
