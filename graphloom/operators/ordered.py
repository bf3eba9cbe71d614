"""What depends on the rows before, in each group and in order: without a task that sees a whole group.

Rows are sorted by ranges of group and order and written. Each partition looks back at its own rows; a group that begins in an
earlier partition also needs what that one and those before it hold. Only groups that span partitions have such a past, so it is a table of
at most two rows for each partition, which is broadcast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.cache import written


@dataclass(frozen=True)
class Look:
    """A column made of the rows before: how within a partition, what a partition passes on, how that is
    gathered over partitions, and how both are put together."""

    inside: Column
    passed: Column
    gathered: str
    joined: str


def number() -> Look:
    """The place of a row in its group, from 0."""
    return Look(F.count(F.lit(1)), F.count(F.lit(1)), "sum", "add")


def total(value: str) -> Look:
    """The sum over the rows before."""
    return Look(F.sum(value), F.sum(value), "sum", "add")


def least(value: str) -> Look:
    return Look(F.min(value), F.min(value), "min", "least")


def largest(value: str) -> Look:
    return Look(F.max(value), F.max(value), "max", "greatest")


def previous(value: str) -> Look:
    """The value of the row before as a struct of one field, null where there is no such row."""
    own = F.struct(F.col(value).alias("value"))
    return Look(F.last(own), F.max_by(own, F.col("_pos")), "last", "coalesce")


def last_known(value: str | Column) -> Look:
    """The last value that is not null."""
    own = F.col(value) if isinstance(value, str) else value
    return Look(F.last(own, ignorenulls=True), F.max_by(own, F.when(own.isNotNull(), F.col("_pos"))), "last", "coalesce")


_GATHER = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
_JOIN = {
    "add": lambda own, past: F.coalesce(own + past, own, past),
    "least": F.least,
    "greatest": F.greatest,
    "coalesce": F.coalesce,
}


def looking_back(df: DataFrame, by: list[str], order: list[str], looks: dict[str, Look], sizes: str | None = None) -> DataFrame:
    """``df`` with a column for each of ``looks``; with ``sizes``, also one of that name with the number of rows of the group. Groups are
    equal if their keys are, null keys too. ``written_to`` on the result has the path that can be dropped after use."""
    ordered = df.orderBy(*by, *order).withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    rows, path = written(ordered, "ordered")
    before = W.partitionBy("_part", *by).orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    # a count of no rows is 0, other looks at no rows are null
    local = rows.withColumns({n: look.inside.over(before) for n, look in looks.items()})
    whole = W.partitionBy("_part", *by)
    if sizes is not None:
        local = local.withColumn(sizes, F.count(F.lit(1)).over(whole))
    parts = rows.groupBy("_part", *by).agg(*[look.passed.alias(n) for n, look in looks.items()], F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*by)
    past = parts.withColumn("_parts", F.count(F.lit(1)).over(group)).filter("_parts > 1")
    past = past.select(
        F.col("_part").alias("_of"), *[F.col(c).alias(f"_by_{c}") for c in by],
        *[_GATHER[look.gathered](n).over(earlier).alias(f"_past_{n}") for n, look in looks.items()], F.sum("_rows").over(group).alias("_whole"),
    )
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = local.join(F.broadcast(past), same, "left")
    made = [_JOIN[look.joined](F.col(n), F.col(f"_past_{n}")).alias(n) for n, look in looks.items()]
    if sizes is not None:
        made.append(F.coalesce("_whole", sizes).alias(sizes))
    out = met.select(*df.columns, *made)
    out.written_to = [path]
    return out
