"""Reshaping of columns: merging, orientation of edge lists, embeddings, profiles."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.neighbors import known_join

from graphloom.functions.features import mlp
from graphloom.operators.metrics import throughput, value_stats


def merge_columns(df: DataFrame, *heads: dict[str, Column]) -> DataFrame:
    """Outputs of several heads side by side; a name that two of them give is an error."""
    names = [n for h in heads for n in h]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"given twice: {', '.join(twice)}")
    return df.withColumns({n: c for h in heads for n, c in h.items()})


def dense_column(df: DataFrame, inputs: list[str], output: str, weights: list, activation: str = "silu") -> DataFrame:
    """``df`` with one column made of others by a small network."""
    return df.withColumn(output, mlp([F.col(c) for c in inputs], weights, activation)[0])


def nested(df: DataFrame, path: tuple[str, ...]) -> Column:
    """The column at a path of names; KeyError if the schema has no such path."""
    kind = df.schema
    for name in path:
        if not hasattr(kind, "fieldNames") or name not in kind.fieldNames():
            raise KeyError(".".join(path))
        kind = kind[name].dataType
    return F.col(".".join(f"`{name}`" for name in path))


def distinct_in_order(names: Column) -> Column:
    """An array's entries without repetitions, in the order in which they come first."""
    return F.array_distinct(names)


def strip_inputs(df: DataFrame, *names: str) -> DataFrame:
    """Without targets and extras."""
    return df.drop(*(names or ("targets", "extras")))


def oriented(edges: Column) -> Column:
    """An ``array<array<long>>`` of shape (E, 2) or (2, E) as (E, 2); (2, 2) counts as (E, 2), and any other
    shape is an error."""
    pairs = F.forall(edges, lambda r: F.size(r) == 2)
    two = F.size(edges) == 2
    swapped = F.transform(F.arrays_zip(F.get(edges, F.lit(0)).alias("a"), F.get(edges, F.lit(1)).alias("b")), lambda r: F.array(r["a"], r["b"]))
    even = F.size(F.get(edges, F.lit(0))) == F.size(F.get(edges, F.lit(1)))
    return F.when(pairs, edges).when(two & even, swapped).otherwise(F.raise_error(F.lit("edges are neither (E, 2) nor (2, E)")).cast("array<array<bigint>>"))


def joint_embedding(df: DataFrame, code: str, table: DataFrame, continuous: list[Column], weights: list[tuple[list[float], float]], names: list[str]) -> DataFrame:
    """One dense layer over a looked-up row ``table(code, e0, e1, ...)`` and continuous columns; a code that the table
    lacks is an error when the row is read."""
    if len(set(names)) != len(names):
        raise ValueError("output names repeat")
    looked_up = [c for c in table.columns if c != code]
    joined = known_join(df, table, [code], "no embedding for")
    inputs = [F.col(c) for c in looked_up] + continuous
    outputs = {n: sum((x * w for x, w in zip(inputs, row, strict=True)), F.lit(bias)) for n, (row, bias) in zip(names, weights, strict=True)}
    return joined.withColumns(outputs).drop(*looked_up)


def decoded_label(label: Column, names: list[str]) -> Column:
    """A name by number; others become ``UNK_<number>``."""
    known = F.get(F.array(*map(F.lit, names)), F.when((label >= 0) & (label < len(names)), label).cast("int"))
    return F.coalesce(known, F.concat(F.lit("UNK_"), label.cast("string")))


def weighted_harmonics(weights: Column, harmonics: Column) -> Column:
    """Outer product of channel weights and harmonics, flattened channel by channel."""
    return F.flatten(F.transform(weights, lambda w: F.transform(harmonics, lambda y: w * y)))


def residual(x: Column, update: Column, ratio: float) -> Column:
    """``(x + ratio * update) / sqrt(1 + ratio^2)``."""
    return (x + update * ratio) / (1 + ratio * ratio) ** 0.5


def profile(action: Callable[[], int], spark, steps: int = 10, warm_up: int = 2) -> DataFrame:
    """Run an action that returns a number of items, time it, and summarise in one row."""
    for _ in range(warm_up):
        action()
    rows = []
    for k in range(steps):
        start = time.perf_counter()
        n = action()
        rows.append((k, time.perf_counter() - start, float(n)))
    df = spark.createDataFrame(rows, "step int, seconds double, items double")
    return df.agg(*value_stats(F.col("seconds")), throughput(F.col("items"), F.col("seconds")).alias("items_per_second"))
