"""Tasks that are fitted on one table and applied to another."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class AtomicDress:
    """Least squares of a target on element counts; applying it takes the fitted part off the target.

    One aggregate gathers the k x k Gram matrix, whatever the number of rows; the pseudo-inverse of that
    matrix gives the solution of least norm. Elements that are not listed count for nothing."""

    elements: list[str | int]
    target: str
    counts: list[str]
    energies: dict = field(default_factory=dict, compare=False)

    def fit(self, df: DataFrame) -> DataFrame:
        k = len(self.counts)
        c = [F.col(x).cast("double") for x in self.counts]
        gram = [F.sum(c[i] * c[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        rhs = [F.sum(c[i] * F.col(self.target)).alias(f"r{i}") for i in range(k)]
        row = df.agg(*gram, *rhs).first()
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
        solution = np.linalg.pinv(g) @ np.array([row[f"r{i}"] or 0.0 for i in range(k)])
        self.energies = dict(zip(self.elements, solution.tolist(), strict=True))
        return df.sparkSession.createDataFrame(list(self.energies.items()), f"element {'string' if isinstance(self.elements[0], str) else 'int'}, energy double")

    def apply(self, df: DataFrame) -> DataFrame:
        part = sum((F.col(c) * self.energies[e] for c, e in zip(self.counts, self.elements, strict=True)), F.lit(0.0))
        return df.withColumn(self.target, F.col(self.target) - part)

    def state(self) -> dict:
        return {"energies": dict(self.energies)}

    def load(self, state: dict) -> None:
        # names of a stored state are texts
        kind = type(self.elements[0])
        self.energies = {kind(k): v for k, v in state["energies"].items()}


@dataclass
class MeanShift:
    """Takes the mean of a column off it."""

    column: str
    mean: float = field(default=0.0, compare=False)

    def fit(self, df: DataFrame) -> DataFrame:
        out = df.agg(F.coalesce(F.avg(self.column), F.lit(0.0)).alias("mean"))
        self.mean = out.first()["mean"]
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.col(self.column) - self.mean)

    def state(self) -> dict:
        return {"mean": self.mean}

    def load(self, state: dict) -> None:
        self.mean = state["mean"]


def capacity(atoms: DataFrame, edges: DataFrame, batch_size: int) -> DataFrame:
    """Largest numbers of atoms and edges of a graph, and what a padded batch needs."""
    na = atoms.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_atoms"))
    ne = edges.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_edges"))
    both = na.join(F.broadcast(ne))  # one row each
    return both.select("max_atoms", "max_edges", (F.col("max_atoms") * batch_size).alias("pad_atoms"), (F.col("max_edges") * batch_size).alias("pad_edges"))
