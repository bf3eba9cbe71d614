"""Run logs: what rows of a long table of metrics tell beside those before them, and the routing of rows to sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.ordered import largest, last_known, least, looking_back, number, previous


def under(name: Column, prefix: str) -> Column:
    """Whether a dotted name is the prefix or lies below it."""
    return (name == prefix) | name.startswith(prefix + ".")


def is_best(by: list[str], order: list[str], value: str, mode: str = "min") -> Column:
    """Strictly better than all before; the first of a group is the best so far. A window over each group, for groups that
    fit in a task; :func:`best_so_far` has no such limit."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return _better(F.col(value), (F.min if mode == "min" else F.max)(value).over(before), mode)


def _better(value: Column, best: Column, mode: str) -> Column:
    return F.coalesce(value < best if mode == "min" else value > best, F.lit(True))


def best_so_far(df: DataFrame, by: list[str], order: list[str], value: str, mode: str = "min", name: str = "best") -> DataFrame:
    """``df`` with whether a row is strictly better than all before it; the first of a group is."""
    found = looking_back(df, by, order, {"_best": (least if mode == "min" else largest)(value)})
    return found.withColumn(name, _better(F.col(value), F.col("_best"), mode)).drop("_best")


def changes(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "changed") -> DataFrame:
    """``df`` with whether a value differs from that of the row before (the first row counts as a change)."""
    found = looking_back(df, by, order, {"_before": previous(value)})
    return found.withColumn(name, F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.value"))).drop("_before")


def step_speed(df: DataFrame, by: list[str], order: list[str], ts: str, window: int) -> DataFrame:
    """Steps per second in windows of ``window`` steps; the clock of a window starts at the last step before
    it, or at its own first step."""
    rows = looking_back(df.select(*dict.fromkeys([*by, *order, ts])), by, order, {"_step": number(), "_before": previous(ts)})
    rows = rows.withColumn("_window", F.floor(F.col("_step") / window))
    grouped = rows.groupBy(*by, F.col("_window").alias("window")).agg(
        F.count("*").alias("steps"), F.max(ts).alias("_end"), F.coalesce(F.min("_before.value"), F.min(ts)).alias("_start")
    )
    end, start = (F.unix_micros(F.col(c).cast("timestamp")) / 1e6 for c in ("_end", "_start"))
    seconds = end - start
    return grouped.select(*by, "window", "steps", seconds.alias("seconds"), F.when(seconds > 0, F.col("steps") / seconds).otherwise(0.0).alias("speed"))


def every_n(step: Column, n: int, shifted: bool = True) -> Column:
    """``(step + 1) % n == 0``, or ``step % n == 0``."""
    return ((step + 1) % n == 0) if shifted else (step % n == 0)


#: Levels in order, and the kinds of rows of the metrics table.
LEVELS = ["debug", "info", "warning", "error", "critical"]
TABLE_KINDS = ("header", "row")


def rank(level: Column | str) -> Column | int:
    """A level's place in :data:`LEVELS`, from 1; an unknown one has 0."""
    return LEVELS.index(level) + 1 if isinstance(level, str) else F.array_position(F.array(*map(F.lit, LEVELS)), level)


def sinks(channel: Column, kind: Column, level: Column, *, metrics: str = "metrics", events: str = "events", console: str = "warning", file: str = "info") -> Column:
    """The sinks of a row, by channel, kind and level.

    ``stdout`` shows the metrics and events channels (and those below them), and everything from the console's level on; ``train.log`` is a
    full record from the file's level on; ``metrics.csv`` has header and table rows of the metrics channel and
    ``events.log`` the events channel, both from ``info`` on; ``warnings.log`` has warnings and worse."""
    measured, told, at = under(channel, metrics), under(channel, events), rank(level)
    informed = at >= rank("info")
    gates = {
        "stdout": measured | told | (at >= rank(console)),
        "train.log": at >= rank(file),
        "metrics.csv": informed & measured & kind.isin(*TABLE_KINDS),
        "events.log": informed & told,
        "warnings.log": at >= rank("warning"),
    }
    return F.array_compact(F.array(*[F.when(gate, F.lit(name)) for name, gate in gates.items()]))


def first_headers(rows: DataFrame, by: list[str], order: list[str], kind: str = "kind", columns: str = "columns") -> DataFrame:
    """Rows without the headers whose columns are those of the header before; other rows pass untouched."""
    header = F.col(kind).eqNullSafe(F.lit("header"))
    found = looking_back(rows, by, order, {"_before": last_known(F.when(header, F.col(columns)))})
    return found.filter(~header | ~F.col(columns).eqNullSafe(F.col("_before"))).drop("_before")


def csv_field(value: Column) -> Column:
    """A number's CSV field: empty for null, NaN and infinities."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "").otherwise(value.cast("string"))


def csv_text(value: Column) -> Column:
    """A text's CSV field: quoted if it holds a comma, a quote or a line break."""
    return F.when(value.isNull(), "").when(value.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_lines(wide: DataFrame, columns: list[str]) -> Column:
    """A row's line of a CSV file."""
    kinds = {c: wide.schema[c].dataType.simpleString() for c in columns}
    field = {"double": csv_field, "float": csv_field, "boolean": lambda c: csv_text(c.cast("int").cast("string"))}
    return F.concat_ws(",", *[field.get(k, lambda c: csv_text(c.cast("string")))(F.col(c)) for c, k in kinds.items()])


def write_metrics_csv(wide: DataFrame, columns: list[str], path: str) -> None:
    """A folder of CSV files with one header each; fields as in :func:`csv_lines`."""
    numbers = ("double", "float")
    shown = [csv_field(F.col(c)).alias(c) if wide.schema[c].dataType.simpleString() in numbers else F.col(c) for c in columns]
    wide.select(*shown).write.option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def logged_metrics(long: DataFrame, keys: list[str], by: list[str] | None = None, missing: float | None = None) -> DataFrame:
    """The wide table of long rows ``(step, key, value)``, a column for each listed key; a key that a step lacks is null, or
    ``missing`` (such as NaN, as a console shows it)."""
    found = [F.max(F.when(F.col("key") == k, F.col("value"))) for k in keys]
    return long.groupBy(*(by or ["step"])).agg(*[(c if missing is None else F.coalesce(c, F.lit(missing))).alias(k) for k, c in zip(keys, found, strict=True)])


def tracked_scalars(long: DataFrame, prefixes: list[str], every: int = 1) -> DataFrame:
    """Rows ``(step, key, value)`` for a scalar tracker: keys that begin with a prefix, each ``every`` steps."""
    chosen = F.lit(False)
    for p in prefixes:
        chosen = chosen | F.col("key").startswith(p)
    return long.filter(chosen & every_n(F.col("step"), every, shifted=False))


def kept_checkpoints(steps: DataFrame, by: list[str], order: list[str], value: str, *, every: int, mode: str = "min") -> DataFrame:
    """Rows with why a checkpoint of their step is kept: ``best`` so far, ``periodic``, or the ``last`` of its run."""
    found = looking_back(steps, by, order, {"_place": number(), "_best": (least if mode == "min" else largest)(value)}, sizes="_size")
    place = F.col("_place") + 1
    best = _better(F.col(value), F.col("_best"), mode)
    why = F.array_compact(F.array(F.when(best, F.lit("best")), F.when(place % every == 0, F.lit("periodic")), F.when(place == F.col("_size"), F.lit("last"))))
    return found.withColumn("kept_as", why).filter(F.size("kept_as") > 0).drop("_place", "_best", "_size")
