"""Declarations: what a statistic reads of an event, and the adapters that rewrite it.

A statistic is an immutable declaration. Adapters return a new one with a further
rewriting step; the step that was added last runs first. `rows` turns the columns of an
event into those that the statistic sees, before Catalyst plans anything."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODALITIES = ("series", "discrete", "paired", "vector")


@dataclass(frozen=True)
class Row:
    """Columns of an event. `accept` is None if all events count."""

    value: Column | None = None
    x: Column | None = None
    y: Column | None = None
    vector: Column | None = None
    ts: Column | None = None
    seq: Column | None = None
    weight: Column | None = None
    accept: Column | None = None

    @property
    def w(self) -> Column:
        return F.lit(1.0) if self.weight is None else self.weight.cast("double")

    def only(self, test: Column) -> Row:
        return replace(self, accept=test if self.accept is None else self.accept & test)

    def kept(self, expr: Column) -> Column:
        """expr for events that count, else null (which aggregates skip)."""
        return expr if self.accept is None else F.when(self.accept, expr)


def nanos(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * F.lit(1000)


@dataclass(frozen=True)
class Events:
    """A table with the columns of its events. Rows whose value is null are left out."""

    df: DataFrame
    row: Row

    def with_rows(self, row: Row) -> Events:
        return Events(self.df, row)


def _column(c) -> Column | None:
    return F.col(c) if isinstance(c, str) else c


def _events(df: DataFrame, needed: list[Column], ts, weight, seq, **columns) -> Events:
    for c in needed:
        df = df.where(c.isNotNull())
    return Events(df, Row(ts=_column(ts), weight=_column(weight), seq=_column(seq), **columns))


def series(df: DataFrame, value, ts=None, weight=None, seq=None) -> Events:
    v = _column(value).cast("double")
    return _events(df, [v], ts, weight, seq, value=v)


def discrete(df: DataFrame, value, ts=None, weight=None, seq=None) -> Events:
    v = _column(value).cast("long")
    return _events(df, [v], ts, weight, seq, value=v)


def paired(df: DataFrame, x, y, ts=None, weight=None, seq=None) -> Events:
    a, b = _column(x).cast("double"), _column(y).cast("double")
    return _events(df, [a, b], ts, weight, seq, x=a, y=b)


def vector(df: DataFrame, values, ts=None, weight=None, seq=None) -> Events:
    v = _column(values).cast("array<double>")
    return _events(df, [v], ts, weight, seq, vector=v)


Step = Callable[[Row], Row]


class Stat:
    """Base of all declarations."""

    modality = "series"
    #: flat: scalar columns in one aggregate; keyed: a cell for each key and index; ordered: depends on arrival.
    kind = "flat"
    #: Whether a result is one row a group, so that it is a struct in a group.
    single = False

    def __init__(self) -> None:
        self.steps: tuple[Step, ...] = ()
        self.mapping: tuple[Callable[[dict[str, Column]], dict[str, Column]], ...] = ()

    def _with(self, step: Step, modality: str | None = None) -> Any:
        out = copy.copy(self)
        out.steps = (*self.steps, step)
        if modality:
            out.modality = modality
        return out

    def _need(self, *modalities: str) -> None:
        if self.modality not in modalities:
            raise TypeError(f"a {self.modality} statistic has no such adapter")

    def rows(self, row: Row) -> Row:
        for step in reversed(self.steps):
            row = step(row)
        return row

    def results(self, fields: dict[str, Column]) -> dict[str, Column]:
        for f in self.mapping:
            fields = f(fields)
        return fields

    def compatible(self, other: Stat) -> None:
        """Raises if states of the two can't be merged."""
        if type(self) is not type(other) or self.parameters() != other.parameters():
            raise ValueError(f"{type(self).__name__} states with different parameters can't be merged")

    def parameters(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("steps", "mapping", "modality")}

    # Filters
    def filter(self, test: Callable[..., Column]):
        def step(r: Row) -> Row:
            if self.modality == "paired":
                return r.only(test(r.x, r.y))
            return r.only(test(r.vector if self.modality == "vector" else r.value))

        return self._with(step)

    # Transforms
    def transform_value(self, f: Callable[[Column], Column]):
        self._need("series", "discrete")
        kind = "long" if self.modality == "discrete" else "double"
        return self._with(lambda r: replace(r, value=f(r.value).cast(kind)))

    def with_value(self, value: float):
        return self.transform_value(lambda _: F.lit(value))

    def transform_pair(self, f: Callable[[Column, Column], tuple[Column, Column]]):
        self._need("paired")

        def step(r: Row) -> Row:
            x, y = f(r.x, r.y)
            return replace(r, x=x, y=y)

        return self._with(step)

    def transform_x(self, f: Callable[[Column], Column]):
        return self.transform_pair(lambda x, y: (f(x), y))

    def transform_y(self, f: Callable[[Column], Column]):
        return self.transform_pair(lambda x, y: (x, f(y)))

    def transform_vector(self, f: Callable[[Column], Column]):
        self._need("vector")
        return self._with(lambda r: replace(r, vector=f(r.vector)))

    def as_series(self):
        """A discrete statistic fed with doubles: truncated toward zero, held to the range
        of 64 bits, NaN as 0."""
        self._need("discrete")
        most = float(2**63)

        def step(r: Row) -> Row:
            v = r.value
            whole = F.when(F.isnan(v), F.lit(0).cast("long")).when(v >= most, F.lit(2**63 - 1)).when(v <= -most, F.lit(-(2**63))).otherwise(v.cast("long"))
            return replace(r, value=whole)

        return self._with(step, "series")

    def as_discrete(self):
        """A series statistic fed with 64-bit integers."""
        self._need("series")
        return self._with(lambda r: replace(r, value=r.value.cast("double")), "discrete")

    # Weights
    def with_weight(self, weight: float):
        return self._with(lambda r: replace(r, weight=F.lit(float(weight))))

    # Selectors
    def at_x(self):
        self._need("series")
        return self._with(lambda r: replace(r, value=r.x), "paired")

    def at_y(self):
        self._need("series")
        return self._with(lambda r: replace(r, value=r.y), "paired")

    def at_index(self, i: int):
        """The vector's element i from 0; a shorter vector is an error."""
        self._need("series")
        return self._with(lambda r: replace(r, value=F.element_at(r.vector, i + 1)), "vector")

    def at_indices(self, i: int, j: int):
        self._need("paired")
        return self._with(lambda r: replace(r, x=F.element_at(r.vector, i + 1), y=F.element_at(r.vector, j + 1)), "vector")

    # Axes
    def with_time_as_x(self):
        self._need("paired")
        return self._with(lambda r: replace(r, x=r.ts / F.lit(1e9), y=r.value), "series")

    def with_time_as_y(self):
        self._need("paired")
        return self._with(lambda r: replace(r, x=r.value, y=r.ts / F.lit(1e9)), "series")

    def with_fixed_x(self, x: float):
        self._need("paired")
        return self._with(lambda r: replace(r, x=F.lit(float(x)), y=r.value), "series")

    def with_fixed_y(self, y: float):
        self._need("paired")
        return self._with(lambda r: replace(r, x=r.value, y=F.lit(float(y))), "series")

    # Folds
    def fold_vector(self, f: Callable[[Column], Column]):
        self._need("series")
        return self._with(lambda r: replace(r, value=f(r.vector)), "vector")

    def fold_paired(self, f: Callable[[Column, Column], Column]):
        self._need("series")
        return self._with(lambda r: replace(r, value=f(r.x, r.y)), "paired")

    # Results
    def map_result(self, forward: Callable[[dict[str, Column]], dict[str, Column]]):
        """Rewrites the result's fields. States are merged before it, so no way back is needed."""
        out = copy.copy(self)
        out.mapping = (*self.mapping, forward)
        return out

    def locked(self):
        """The declaration itself: tasks own their state, there is nothing to lock."""
        return self


def merged_fields(struct: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(k) for k, c in struct.items()))
