"""Layers on scalar and vector channels, as joins with weight tables and column expressions.

A feature is a list of scalar columns (l = 0) and a list of ``(x, y, z)`` column triples (l = 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import physics as ph
from graphloom.functions.features import argmax, mlp, softmax, softplus
from graphloom.operators.columns import decoded_label
from graphloom.operators.neighbors import lookup
from graphloom.operators.pooling import pool
from graphloom.operators.potentials import conserve_charge

Vector = tuple[Column, Column, Column]


def linear_scalars(xs: list[Column], weights: list[list[float]]) -> list[Column]:
    """A dense layer over scalar channels, a row of weights for each output."""
    return [sum((x * w for x, w in zip(xs, row, strict=True)), F.lit(0.0)) for row in weights]


def linear_vectors(vs: list[Vector], weights: list[list[float]]) -> list[Vector]:
    """The same over vector channels: one weight per channel, shared by its components."""
    return [tuple(sum((v[k] * w for v, w in zip(vs, row, strict=True)), F.lit(0.0)) for k in range(3)) for row in weights]


def tensor_product(s: Column, v: Vector, y0: Column, y1: Vector) -> tuple[list[Column], list[Vector]]:
    """All paths of (0 + 1) x (0 + 1) that end in l = 0 or 1: scalars ``s y0`` and ``v . y1 / sqrt 3``, vectors
    ``s y1``, ``v y0`` and ``v x y1 / sqrt 2``."""
    scalars = [s * y0, ph.dot(v, y1) / 3**0.5]
    crossed = tuple(c / 2**0.5 for c in ph.cross(v, y1))
    return scalars, [tuple(s * c for c in y1), tuple(c * y0 for c in v), crossed]


def by_species(atoms: DataFrame, weights: DataFrame, key: str = "z_num") -> DataFrame:
    """Atoms beside their species' weights ``weights(key, w0, w1, ...)``; an atom of another species, or of none, is
    an error when its key or a weight is read."""
    found = lookup(atoms, weights, key)
    # a weight reads the checked key, so that the check is not left out with it
    return found.withColumns({c: F.when(F.col(key).isNotNull(), F.col(c)) for c in weights.columns if c != key})


def element_update(h: list[Column], m: list[Column], weights: list[list[Column]]) -> list[Column]:
    """``h + W m`` with the species' own matrix, given as columns."""
    return [x + sum((y * w for y, w in zip(m, row, strict=True)), F.lit(0.0)) for x, row in zip(h, weights, strict=True)]


def symmetric_contraction(s: Column, v: Vector, w: list[Column]) -> Column:
    """Invariant products of one channel up to order three: ``w0 s + w1 s^2 + w2 |v|^2 + w3 s^3 + w4 s |v|^2``."""
    square = ph.dot(v, v)
    return w[0] * s + w[1] * s * s + w[2] * square + w[3] * s * s * s + w[4] * s * square


def scalar_contraction(h: list[Column], w: list[list[Column]]) -> list[Column]:
    """Products of each scalar channel with itself, ``w1 h + w2 h^2 + ...``, with the species' own weights: a list of
    orders for each channel."""
    return [sum((weight * ph.power(x, k) for k, weight in enumerate(orders, 1)), F.lit(0.0)) for x, orders in zip(h, w, strict=True)]


def product_head(h: list[Column], w: list[list[Column]], weights: list[list[float]], bias: list[float]) -> list[Column]:
    """Many-body products of the channels, then a dense layer."""
    return [x + b for x, b in zip(linear_scalars(scalar_contraction(h, w), weights), bias, strict=True)]


def scalar_head(atoms: DataFrame, graphs: DataFrame, inputs: list[str], weights: list, pooling: str = "mean") -> DataFrame:
    """``(graph_id, value)``: a small network over pooled features (mean, sum or max) of the atoms of each graph."""
    pooled = pool(atoms, graphs, ["graph_id"], inputs, pooling)
    return pooled.select("graph_id", mlp([F.col(c) for c in inputs], weights)[0].alias("value"))


def type_head(atoms: DataFrame, inputs: list[Column], weights: list, names: list[str]) -> DataFrame:
    """Atoms with the most likely of ``names`` as ``label`` and its probability as ``confidence``."""
    scored = atoms.withColumn("_logits", F.array(*mlp(inputs, weights)))
    at = argmax(F.col("_logits"))
    return scored.withColumns({"label": decoded_label(at, names), "confidence": F.array_max(softmax(F.col("_logits")))}).drop("_logits")


def energy_head(atoms: DataFrame, inputs: list[Column], weights: list) -> DataFrame:
    """``(graph_id, energy)``: a small network's output of each atom, summed."""
    return atoms.select("graph_id", mlp(inputs, weights)[0].alias("e")).groupBy("graph_id").agg(F.sum("e").alias("energy"))


def parameter_head(inputs: list[Column], weights: list, floor: float = 1e-4) -> list[Column]:
    """Positive parameters: softplus of a small network's outputs, plus a floor."""
    return [softplus(x) + floor for x in mlp(inputs, weights)]


def charge_head(atoms: DataFrame, inputs: list[Column], weights: list, total: Column) -> DataFrame:
    """Atoms with a charge ``q`` from a small network, shifted so that each graph's charge is ``total``."""
    return conserve_charge(atoms.withColumn("q", mlp(inputs, weights)[0]), "q", total)
