"""Error metrics and losses as lists of aggregate columns: any number of them in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.cache import drop_written, written


def mae(p: Column, t: Column) -> Column:
    return F.coalesce(F.avg(F.abs(p - t)), F.lit(0.0))


def mse(p: Column, t: Column) -> Column:
    return F.coalesce(F.avg((p - t) * (p - t)), F.lit(0.0))


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(mse(p, t))


def r2(p: Column, t: Column) -> Column:
    """``1 - SSres / SStot``; 0 for a constant target."""
    both = p.isNotNull() & t.isNotNull()
    total = F.var_pop(F.when(both, t)) * F.count_if(both)
    return F.coalesce(F.when(total > 0, 1 - F.sum((p - t) * (p - t)) / total), F.lit(0.0))


def accuracy(p: Column, t: Column) -> Column:
    return F.coalesce(F.avg((p == t).cast("double")), F.lit(0.0))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"mae": mae, "mse": mse, "rmse": rmse, "r2": r2, "accuracy": accuracy}


def evaluate(df: DataFrame, names: list[str], pred: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Named metrics of a table of predictions, together."""
    columns = [METRICS[n](F.col(pred), F.col(target)).alias(n) for n in names]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def weighted_loss(df: DataFrame, terms: list[tuple[float, str, str, str]]) -> DataFrame:
    """``sum of weight * loss``; a term ``(weight, "mse" | "mae", pred, target)`` whose columns are not there
    is left out."""
    total = F.lit(0.0)
    for weight, kind, pred, target in terms:
        if pred in df.columns and target in df.columns:
            total = total + weight * METRICS[kind](F.col(pred), F.col(target))
    return df.agg(total.alias("loss"))


def loss(df: DataFrame, kind: str, pred: str, target: str, reduction: str = "mean") -> DataFrame:
    """A squared (``mse``) or absolute (``mae``) loss as ``loss``: its mean, its sum, or that of each row."""
    d = F.col(pred) - F.col(target)
    each = {"mse": d * d, "mae": F.abs(d)}[kind]
    if reduction == "none":
        return df.withColumn("loss", each)
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    return df.agg(F.coalesce((F.avg if reduction == "mean" else F.sum)(each), F.lit(0.0)).alias("loss"))


def mergeable(df: DataFrame, pred: str, target: str, by: list[str] | None = None) -> DataFrame:
    """States from which all metrics follow, and which :func:`merged` puts together for parts of a table: sums over rows with
    both values, and the mean of the targets with the sum of their squared deviations from it."""
    p, t = F.col(pred), F.col(target)
    d = p - t
    own = F.when(d.isNotNull(), t)
    zero = F.lit(0.0)
    sums = [
        F.count(d).alias("n"),
        F.coalesce(F.sum(F.abs(d)), zero).alias("sum_abs"),
        F.coalesce(F.sum(d * d), zero).alias("sum_square"),
        F.count_if(d.isNotNull() & (p == t)).alias("n_right"),
        F.coalesce(F.avg(own), zero).alias("mean"),
        F.coalesce(F.var_pop(own) * F.count(own), zero).alias("deviation"),
    ]
    return df.groupBy(*(by or [])).agg(*sums)


def merged(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics of all parts whose states are given; 0 where there is no row, and ``r2`` 0 for a constant target. Deviations of the parts'
    means from the whole's are added to those within them, so nothing cancels where targets are far from zero."""
    keys = by or ["_all"]
    states = states if by else states.withColumn("_all", F.lit(0))
    groups = [F.col(c).alias(f"_of_{c}") for c in keys]
    means = states.groupBy(*groups).agg((F.sum(F.col("n") * F.col("mean")) / F.greatest(F.sum("n"), F.lit(1))).alias("_mean"))
    # what rounding leaves between this mean and the true one is corrected by the drift below
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    met = states.join(means, same)
    n, a, s, right, within = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "sum_abs", "sum_square", "n_right", "deviation"))
    off = F.col("mean") - F.col("_mean")
    between, drift = F.coalesce(F.sum(F.col("n") * off * off), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * off), F.lit(0.0))
    least = F.greatest(n, F.lit(1))
    deviation = within + between - drift * drift / least
    out = [(a / least).alias("mae"), (s / least).alias("mse"), F.sqrt(s / least).alias("rmse"), F.when(deviation > 0, 1 - s / deviation).otherwise(0.0).alias("r2"), (right / least).alias("accuracy")]
    return met.groupBy(*keys).agg(*out).drop("_all")


#: Values of a group that a task sorts at most, and the ranges that a larger one is cut into at a time.
TASK_VALUES, RANGES = 1 << 16, 1024


def value_stats(value: Column, exact: bool = True) -> list[Column]:
    """Mean, population deviation, median, 95th percentile (interpolated), least and largest, as aggregates. Exact percentiles keep
    all different values of a group in one task (:func:`value_table` does not); otherwise they are close to a hundred-thousandth of
    the ranks."""
    p = (F.percentile if exact else lambda c, at: F.percentile_approx(c, at, 100_000))(value, F.array(F.lit(0.5), F.lit(0.95)))
    return [
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.get(p, F.lit(0)).alias("p50"),
        F.get(p, F.lit(1)).alias("p95"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def value_table(df: DataFrame, by: list[str], value: str, *, task_values: int = TASK_VALUES, ranges: int = RANGES) -> DataFrame:
    """The columns of :func:`value_stats` for each group, with exact percentiles of groups of any size."""
    largest = df.groupBy(*by).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= task_values:
        return df.groupBy(*by).agg(*value_stats(F.col(value)))
    found = percentiles(df, by, value, {"p50": 0.5, "p95": 0.95}, task_values=task_values, ranges=ranges)
    rest = [c for k, c in enumerate(value_stats(F.col(value), exact=False)) if k not in (2, 3)]
    plain = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(*rest)
    met = plain.join(found, _same(by), "left")
    return met.select(*[F.col(f"_of_{c}").alias(c) for c in by], "mean", "std", "p50", "p95", "min", "max")


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return out


def percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], *, task_values: int = TASK_VALUES, ranges: int = RANGES) -> DataFrame:
    """``(by, <name>, ...)``: interpolated percentiles of each group, exact, by selection of ranks.

    Values between a group's least and largest are counted in ``ranges`` equal ranges; the one that holds a wanted rank is cut into ranges
    again, and so on, until it has at most ``task_values`` values or one value alone. Then these are sorted. A pass reads the table
    and shuffles counts of ranges; what it finds, a row for each group and rank, is written. Nulls do not count; values that are not
    finite are an error."""
    spark, v = df.sparkSession, F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).when(v.isNotNull(), F.raise_error(F.lit(f"{value} is not finite")).cast("double"))
    rows = df.select(*by, finite.alias("_v")).filter(F.col("_v").isNotNull())
    keys = [f"_of_{c}" for c in by]
    sizes = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p)) for p in at.values()])))
    wanted = sizes.select(*keys, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_inside"))
    held, path = written(wanted, "ranks")
    sizes_held, sizes_path = written(sizes, "sizes")
    paths = [sizes_path]
    live = (F.col("_inside") > task_values) & (F.col("_lo") < F.col("_hi"))
    inside = _same(by) & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    while not held.filter(live).isEmpty():
        cut = held.filter(live).select(*keys, "_lo", "_hi").distinct()
        # halves, so that a difference never overflows
        place = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * ranges)
        counted = rows.join(cut, inside).groupBy(*keys, "_lo", "_hi", F.least(place, F.lit(ranges - 1)).alias("_range"))
        counted = counted.agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        ahead = W.partitionBy(*keys, "_lo", "_hi").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # at most ``ranges`` rows
        counted = counted.withColumn("_ahead", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
        names = {c: f"{c}_" for c in [*keys, "_lo", "_hi"]}
        on = F.lit(True)
        for c, n in names.items():
            on = on & F.col(c).eqNullSafe(F.col(n))
        left = F.col("_rank") - F.col("_before") - F.col("_ahead")
        found = held.filter(live).join(counted.withColumnsRenamed(names), on & (left >= 0) & (left < F.col("_c")))
        found = found.select(*keys, "_rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), (F.col("_before") + F.col("_ahead")).alias("_before"), F.col("_c").alias("_inside"))
        after, next_path = written(held.filter(~live).unionAll(found), "ranks")
        drop_written(spark, path)
        held, path = after, next_path
    sets = held.filter("_lo < _hi").select(*keys, "_lo", "_hi").distinct()
    values = rows.join(sets, inside).groupBy(*keys, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    values = values.withColumnsRenamed({c: f"{c}_" for c in [*keys, "_lo", "_hi"]})
    on = F.lit(True)
    for c in [*keys, "_lo", "_hi"]:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_"))
    picked = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.get("_values", (F.col("_rank") - F.col("_before")).cast("int")))
    picked = held.join(values, on, "left").select(*keys, "_rank", picked.alias("_value"))
    listed = picked.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_by_rank"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    met = sizes_held.join(listed, on)

    def between(p: float) -> Column:
        place = (F.col("_n") - 1) * p
        low, high = (F.try_element_at("_by_rank", f(place)) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    out = met.select(*[F.col(k).alias(k.removeprefix("_of_")) for k in keys], *[between(p).alias(n) for n, p in at.items()])
    out.written_to = [path, *paths]
    return out


def throughput(count: Column, seconds: Column) -> Column:
    """Mean count over mean seconds; 0 if no time passed."""
    return F.when(F.avg(seconds) > 0, F.avg(count) / F.avg(seconds)).otherwise(0.0)
