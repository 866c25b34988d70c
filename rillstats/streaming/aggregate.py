"""Structured Streaming: flat and keyed statistics are ordinary grouped aggregates over
event-time windows; folds in order of arrival keep state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keyed import Keyed
from ..plans import run
from ..plans.stat import Events, Stat


def _windowed(events: Events, time: str, duration: str, slide: str | None, delay: str) -> Events:
    df = events.df.withWatermark(time, delay).withColumn("window", F.window(time, duration, slide))
    return Events(df, events.row)


def stream_aggregate(events: Events, stats: dict[str, Stat], by: list[str], time: str, duration: str, slide: str | None = None, delay: str = "1 hour", shift: float | None = None) -> DataFrame:
    """Results a window and key. A stream can't be read twice, so weighted moments take
    their shift as a parameter, a number near the data; without it they raise an error."""
    keyed = _windowed(events, time, duration, slide, delay)
    return run.aggregate(keyed, stats, [*by, "window"], shift=shift)


def stream_cells(events: Events, sketch: Keyed, by: list[str], time: str, duration: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A sketch's cells a window and key; batch reads take them from the sink."""
    keyed = _windowed(events, time, duration, slide, delay)
    return sketch.cells(keyed, [*by, "window"])


def fold_in_order(df: DataFrame, key: str, seq: str, value: str, weight: str | None, step, start: tuple[float, ...], names: list[str]) -> DataFrame:
    """For each key the state after each batch: step(state, value, weight) -> state over
    the batch's events by seq. For statistics that depend on order."""
    kind = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"{n} double" for n in names)

    def run_batch(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start
        own = pd.concat(list(frames)).sort_values(seq, kind="stable")
        weights = own[weight] if weight else [1.0] * len(own)
        for v, w in zip(own[value], weights):
            now = step(now, float(v), float(w))
        state.update(tuple(now))
        yield pd.DataFrame([(k[0], *now)], columns=[key, *names])

    return df.groupBy(key).applyInPandasWithState(run_batch, f"`{key}` {kind}, {fields}", fields, "update", GroupStateTimeout.NoTimeout)
