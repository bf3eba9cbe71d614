"""Run logs over streams: what a row tells beside all rows before it, with a state for each key that outlives micro-batches.

Rows of a key are taken in their order within a micro-batch, and micro-batches one after the other: the results are those of the batch
functions of :mod:`graphloom.operators.runlog` if rows arrive in order. A key's rows of one micro-batch meet in one task, in chunks of
Arrow batches; how many that are is bounded by how much the stream takes in at a time (``maxFilesPerTrigger``)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType


def _sorted(chunks: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of a micro-batch in order."""
    return pd.concat(list(chunks), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def tracked(events: DataFrame, by: list[str], order: list[str], *, best: str, watched: str, mode: str = "min") -> DataFrame:
    """Rows with ``best``, whether the value of that column is strictly better than all before it in its group (a first
    value, and one that is null, is), and ``changed``, whether ``watched`` differs from the row before (a first row does).

    The state of a group is its best value, the last watched one, and whether there was a row."""
    out = StructType([*events.schema.fields, StructField("best", BooleanType()), StructField("changed", BooleanType())])
    state_type = StructType([StructField("best", DoubleType()), StructField("last", StringType()), StructField("seen", BooleanType())])

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        so_far, last, seen = state.get if state.exists else (None, None, False)
        rows = _sorted(chunks, order)
        better, differs = [], []
        for value, own in zip(rows[best].tolist(), rows[watched].tolist(), strict=True):
            value = None if pd.isna(value) else float(value)
            better.append(value is None or so_far is None or (value < so_far if mode == "min" else value > so_far))
            if value is not None:
                so_far = value if so_far is None else min(so_far, value) if mode == "min" else max(so_far, value)
            name = None if pd.isna(own) else str(own)
            differs.append(not seen or name != last)
            last, seen = name, True
        state.update((so_far, last, seen))
        yield rows.assign(best=better, changed=differs)[out.fieldNames()]

    return events.groupBy(*by).applyInPandasWithState(run, out, state_type, "append", GroupStateTimeout.NoTimeout)


def first_headers(rows: DataFrame, by: list[str], order: list[str], kind: str = "kind", columns: str = "columns") -> DataFrame:
    """Rows without the headers whose columns are those of the header before; other rows pass untouched. The state of a group is its last
    header that names columns."""
    state_type = StructType([StructField("last", StringType())])

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        own, kept = _sorted(chunks, order), []
        for is_header, named in zip((own[kind] == "header").tolist(), own[columns].tolist(), strict=True):
            named = None if pd.isna(named) else str(named)
            kept.append(not is_header or named != last)
            if is_header and named is not None:
                last = named
        state.update((last,))
        yield own[kept]

    return rows.groupBy(*by).applyInPandasWithState(run, rows.schema, state_type, "append", GroupStateTimeout.NoTimeout)


def step_speed(events: DataFrame, by: list[str], order: list[str], ts: str, window: int) -> DataFrame:
    """Steps per second of every full window of ``window`` steps, ``(by, window, steps, seconds, speed)``: the clock of a window starts
    at the last step before it, or at its own first step. The state of a group is the number of steps, and when the open window
    began."""
    out = StructType([*[events.schema[c] for c in by], StructField("window", LongType()), StructField("steps", LongType()), StructField("seconds", DoubleType()), StructField("speed", DoubleType())])
    state_type = StructType([StructField("steps", LongType()), StructField("start", LongType())])

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, start = state.get if state.exists else (0, None)
        rows = _sorted(chunks, order)
        made: list[tuple[Any, ...]] = []
        for at in rows[ts].astype("datetime64[us]").astype("int64").tolist():
            start = at if start is None else start
            steps += 1
            if steps % window == 0:
                seconds = (at - start) / 1e6
                made.append((*key, steps // window - 1, window, seconds, window / seconds if seconds > 0 else 0.0))
                start = at
        state.update((steps, start))
        if made:
            yield pd.DataFrame(made, columns=out.fieldNames())

    return events.groupBy(*by).applyInPandasWithState(run, out, state_type, "append", GroupStateTimeout.NoTimeout)
