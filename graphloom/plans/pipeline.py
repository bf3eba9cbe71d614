"""A linear pipeline of table functions and fitted tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame


def hook_order(hooks: list[object]) -> list[object]:
    """Hooks by their ``priority`` (100 if they have none); those of one priority stay in order."""
    return sorted(hooks, key=lambda h: getattr(h, "priority", 100))


def task_id(task: object, version: str | None = None) -> str:
    """What a task does: its own ``task_id()``, or its class with the values of its fields (those that take part in
    comparisons: fitted states do not), or a function's name. A function's name tells nothing of what it does, so its
    ``version`` is part of the id; functions without a name of their own need one."""
    if hasattr(task, "task_id"):
        own = task.task_id()
    elif is_dataclass(task):
        values = ":".join(f"{f.name}={getattr(task, f.name)!r}" for f in fields(task) if f.compare)
        own = f"{type(task).__module__}.{type(task).__qualname__}:{values}"
    else:
        name = getattr(task, "__qualname__", None)
        if version is None and (name is None or "<lambda>" in name):
            raise ValueError(f"{task!r} has no name: give it a version, or a task_id()")
        own = f"{getattr(task, '__module__', '')}.{name}"
    return own if version is None else f"{own}@{version}"


@dataclass(frozen=True)
class Entry:
    name: str
    task: object
    version: str | None = None

    @property
    def fitted(self) -> bool:
        return hasattr(self.task, "fit")


@dataclass(frozen=True)
class PipelineSpec:
    """An immutable list of entries with an id made of its name and its tasks' names and ids."""

    name: str
    entries: tuple[Entry, ...]

    @property
    def id(self) -> str:
        parts = [self.name, *(part for e in self.entries for part in (e.name, task_id(e.task, e.version)))]
        return hashlib.sha256("|".join(f"{len(x)}:{x}" for x in parts).encode()).hexdigest()[:16]

    def run(self, source: DataFrame, fit_source: DataFrame | None = None) -> DataFrame:
        """Fit each task on ``fit_source`` (or the source) as its predecessors left it, then apply it. Fitting
        is one action with a small result; applying stays lazy."""
        fit_on = source if fit_source is None else fit_source
        for e in self.entries:
            if e.fitted:
                e.task.fit(fit_on)
                source, fit_on = e.task.apply(source), e.task.apply(fit_on)
            else:
                source, fit_on = e.task(source), e.task(fit_on)
        return source

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply tasks that are fitted already."""
        for e in self.entries:
            df = e.task.apply(df) if e.fitted else e.task(df)
        return df

    def states(self) -> dict[str, dict]:
        return {e.name: e.task.state() for e in self.entries if e.fitted}

    def load(self, states: dict[str, dict]) -> None:
        """Restore the states of known tasks; unknown names are ignored."""
        for e in self.entries:
            if e.fitted and e.name in states:
                e.task.load(states[e.name])


@dataclass
class Pipeline:
    """Builder: ``Pipeline("qm").add(f).add(task, name="dress").build()``, or ``@pipeline.task``."""

    name: str
    entries: list[Entry] = field(default_factory=list)

    def add(self, task: object, name: str | None = None, version: str | None = None) -> Pipeline:
        if not callable(task) and not (hasattr(task, "fit") and hasattr(task, "apply")):
            raise TypeError(f"{task!r} is no task")
        self.entries.append(Entry(name or getattr(task, "__name__", type(task).__name__), task, version))
        return self

    def task(self, f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        self.add(f)
        return f

    def build(self) -> PipelineSpec:
        return PipelineSpec(self.name, tuple(self.entries))
