"""Scatter and pooling: grouped aggregates over a dense spine of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.neighbors import with_ends
from graphloom.plans.cache import written


def dense(grouped: DataFrame, spine: DataFrame, keys: list[str], fill: dict[str, float]) -> DataFrame:
    """Every key of ``spine`` once, with ``fill`` where ``grouped`` has none."""
    out = spine.select(*keys).distinct().join(grouped, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def scatter_sum(df: DataFrame, index: str, value: str, dim_size: int | None = None) -> DataFrame:
    """``(index, value)`` for 0 .. dim_size - 1 (by default up to the largest index), empty places 0; no rows give
    no places."""
    summed = df.groupBy(F.col(index).cast("long").alias(index)).agg(F.sum(value).alias(value))
    if dim_size is None:
        largest = df.agg(F.max(index)).first()[0]
        dim_size = 0 if largest is None else largest + 1
    spine = df.sparkSession.range(dim_size).withColumnRenamed("id", index)
    return dense(summed, spine, [index], {value: 0.0})


def pool(df: DataFrame, spine: DataFrame, keys: list[str], values: list[str], how: str) -> DataFrame:
    """Sum, mean or max of values for each key of the spine. An empty key's sum and mean are 0 and its max is
    minus infinity."""
    if how == "sum":
        return dense(df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]), spine, keys, dict.fromkeys(values, 0.0))
    if how == "mean":
        means = df.groupBy(*keys).agg(*[(F.sum(v) / F.greatest(F.count(v), F.lit(1))).alias(v) for v in values])
        return dense(means, spine, keys, dict.fromkeys(values, 0.0))
    if how == "max":
        return dense(df.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values]), spine, keys, dict.fromkeys(values, float("-inf")))
    raise ValueError(f"unknown reduction: {how}")


def edge_to_node(edges: DataFrame, atoms: DataFrame, values: list[str], how: str = "sum", end: str = "dst") -> DataFrame:
    """Edge values pooled into atoms by one end of the edge."""
    if how not in ("sum", "mean"):
        raise ValueError(f"unknown reduction: {how}")
    spine = atoms.select("graph_id", F.col("atom_id").alias(end))
    return pool(edges, spine, ["graph_id", end], values, how).withColumnRenamed(end, "atom_id")


def masked(df: DataFrame, keys: list[str], value: str, mask: str) -> DataFrame:
    """Sum, mean and max over rows whose mask holds."""
    on = F.when(F.col(mask), F.col(value))
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(on), F.lit(0.0)).alias("masked_sum"),
        (F.coalesce(F.sum(on), F.lit(0.0)) / F.greatest(F.count(on), F.lit(1))).alias("masked_mean"),
        F.coalesce(F.max(on), F.lit(float("-inf"))).alias("masked_max"),
    )


def pool_layers(layers: Column, how: str) -> Column:
    """An ``array<array<double>>`` of layers as one array: mean, sum or last."""
    if how == "last":
        return F.element_at(layers, -1)
    if how not in ("sum", "mean"):
        raise ValueError(f"unknown reduction: {how}")
    total = F.aggregate(F.slice(layers, 2, F.size(layers)), F.get(layers, F.lit(0)), lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b))
    return total if how == "sum" else F.transform(total, lambda v: v / F.size(layers))


def degree(edges: DataFrame, atoms: DataFrame, end: str = "src") -> DataFrame:
    """``(graph_id, atom_id, degree)``, atoms without an edge included."""
    n = edges.groupBy("graph_id", F.col(end).alias("atom_id")).agg(F.count("*").alias("degree"))
    return dense(n, atoms, ["graph_id", "atom_id"], {"degree": 0})


def messages(edges: DataFrame, atoms: DataFrame, sent: dict[str, str], weight: Column) -> DataFrame:
    """Columns of the edges' sources, times a weight of the edge, summed at the targets: ``sent`` maps the sums' names
    to the columns."""
    own = with_ends(edges, atoms, *sent.values(), ends=("src",))
    weighted = own.select("graph_id", "dst", *[(F.col(f"{c}_src") * weight).alias(n) for n, c in sent.items()])
    return edge_to_node(weighted, atoms, list(sent), "sum")


def environments(edges: DataFrame, value: str, name: str) -> DataFrame:
    """Edges with the sum of a column over all edges of their source, over the root of their number. The edges are written, summed
    by source before the shuffle, and joined with the sums; ``written_to`` on the result has the path that can be dropped after use."""
    rows, path = written(edges, "edges")
    own = rows.groupBy("graph_id", "src").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    out = rows.join(own, ["graph_id", "src"]).withColumn(name, F.col("_sum") / F.sqrt("_n")).drop("_sum", "_n")
    out.written_to = [path]
    return out
