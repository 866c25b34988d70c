"""Sliding windows of slices.

A window is cut into slices of equal length; an event belongs to the slice that its time
lies in (cut toward zero). A reading at t takes slices that start in [t - duration, t].
There are only as many places as slices, one for each slice number modulo their number, and
a place holds the newest slice that has arrived; that is decided before the reading. Any
statistic or group has windows. States whose value ages are taken at their slice's end and
aged at the reading; statistics whose merge depends on the order take slices by place."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import run
from ..plans.groups import StatGroup, Tables
from ..plans.stat import Events, Stat

SLICE = "slice_no"


@dataclass(frozen=True)
class WindowState:
    """by and slice_no of all slices that have an event, and the slices' states, whose tables
    have these columns too."""

    slices: DataFrame
    states: DataFrame | Tables

    def only(self, live: DataFrame, by: list[str]) -> DataFrame | Tables:
        keep = lambda t: run.join_by(t, live, [*by, SLICE], "left_semi")
        return self.states.each(keep) if isinstance(self.states, Tables) else keep(self.states)


@dataclass(frozen=True)
class Windowed:
    """A statistic or group over the last `duration`."""

    stat: Stat | StatGroup
    duration: timedelta
    slices: int = 10

    def __post_init__(self):
        if self.slices < 1 or self.nanos <= 0 or self.length < 1:
            raise ValueError("a window needs a slice or more, each of a nanosecond or more")

    @property
    def nanos(self) -> int:
        return self.duration // timedelta(microseconds=1) * 1000

    @property
    def length(self) -> int:
        return self.nanos // self.slices

    @property
    def _end(self) -> Column:
        """A slice's end, as the time of its state."""
        return (F.col(SLICE) + 1) * F.lit(self.length)

    @property
    def _place(self) -> Column:
        return F.pmod(SLICE, F.lit(self.slices))

    def sliced(self, events: Events) -> Events:
        df = events.df.withColumn("_ts", events.row.ts)
        return Events(df.withColumn(SLICE, F.expr(f"_ts div {self.length}L")).drop("_ts"), events.row)

    def state(self, events: Events, by: list[str] = ()) -> WindowState:
        keyed, by = self.sliced(events), [*by, SLICE]
        return WindowState(keyed.df.select(*by).distinct(), run.state_of(keyed, self.stat, by, self._end))

    def merge(self, states: list[WindowState], by: list[str] = ()) -> WindowState:
        """Slice by slice."""
        slices = states[0].slices
        for s in states[1:]:
            slices = slices.unionByName(s.slices)
        return WindowState(slices.distinct(), run.merge_of([s.states for s in states], self.stat, [*by, SLICE], self._end))

    def active(self, state: WindowState, as_of: int, by: list[str] = ()) -> DataFrame:
        """by and slice_no of the slices that a reading takes."""
        numbers = state.slices.withColumn("_place", self._place)
        newest = numbers.groupBy(*by, "_place").agg(F.max(SLICE).alias(SLICE)).drop("_place")
        start = F.col(SLICE) * F.lit(self.length)
        return newest.where(start.between(F.lit(as_of - self.nanos), F.lit(as_of)))

    def read(self, state: WindowState, as_of: int, by: list[str] = ()) -> DataFrame:
        live = state.only(self.active(state, as_of, by), by)
        joined = run.merge_of([live], self.stat, list(by), as_of, order=self._place)
        return run.read_of(joined, self.stat, list(by), as_of)


def windowed(stat: Stat | StatGroup, duration: timedelta, slices: int = 10) -> Windowed:
    return Windowed(stat, duration, slices)
