"""Runs statistics: at once, as stored states, as merges of states, and in groups.

`states`, `merge`, `read` and `aggregate` are the plans of flat statistics, several in one
aggregate. `state_of`, `merge_of`, `read_of` and `results` take a statistic or group of any
kind; a state is then whatever tables it needs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stat import Events, Stat, merged_fields

STATE = "state"
#: Groups whose shifts are broadcast at most; with more the join is left to a shuffle.
BROADCAST_GROUPS = 500_000


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def as_time(as_of: int | Column | None) -> Column | None:
    return as_of if as_of is None or isinstance(as_of, Column) else F.lit(int(as_of)).cast("long")


def join_by(df: DataFrame, other: DataFrame, by, how: str = "inner") -> DataFrame:
    """df joined to other on the columns of by, where null equals null. Without columns other
    has one row."""
    if not by:
        return df.crossJoin(F.broadcast(other))  # one row
    keys = {b: f"_key{j}" for j, b in enumerate(by)}
    renamed = other.select(*(named(b).alias(k) for b, k in keys.items()), *(named(c) for c in other.columns if c not in by))
    test = None
    for b, k in keys.items():
        one = named(b).eqNullSafe(F.col(k))
        test = one if test is None else test & one
    return df.join(renamed, test, how).drop(*keys.values())


def _flat(stats: Mapping[str, Stat]) -> None:
    for name, s in stats.items():
        if s.kind != "flat":
            raise TypeError(f"{name} is not a flat statistic; it has plans of its own")


def _time(events: Events, stats: Mapping[str, Stat], as_of: int | Column | None) -> Column | None:
    """The time of reading: given, or the largest event time (one small job)."""
    if as_of is None and any(getattr(s, "timed", False) for s in stats.values()):
        as_of = events.df.agg(F.max(events.row.ts)).first()[0]
    return as_time(as_of)


def states(events: Events, stats: Mapping[str, Stat], by: list[str] = (), as_of: int | Column | None = None, shift: float | None = None) -> DataFrame:
    """by columns and a struct of state for each statistic, in one aggregate. as_of may be a
    column made of by columns.

    Weighted moments need a shift. Without one a first aggregate takes each group's mean,
    which is broadcast to the events if there are up to BROADCAST_GROUPS groups by count, so
    events aren't shuffled for it; with one (a number near the data) there is a single pass."""
    _flat(stats)
    by = list(by)
    time, df = _time(events, stats, as_of), events.df
    rows = {n: s.rows(events.row) for n, s in stats.items()}
    wanted = {(n, k): c for n, s in stats.items() for k, c in s.shifts(rows[n]).items()}
    shifts: dict[str, dict[str, Column]] = {n: {} for n in stats}
    if wanted and shift is None and df.isStreaming:
        raise ValueError("a stream can't be read twice: weighted moments need shift=, a number near the data")
    if wanted and shift is None:
        names = {key: f"_shift{j}" for j, key in enumerate(wanted)}
        means = df.groupBy(*by).agg(*(F.avg(c).alias(names[key]) for key, c in wanted.items()))
        if by and not df.isStreaming:
            means = means.persist(StorageLevel.MEMORY_AND_DISK)
            if means.count() <= BROADCAST_GROUPS:
                means = F.broadcast(means)
        df = join_by(df, means, by)
        for (n, k), name in names.items():
            shifts[n][k] = F.col(name)
    else:
        for n, k in wanted:
            shifts[n][k] = F.lit(float(shift))
    partials = {}
    for n, s in stats.items():
        for k, c in s.partials(rows[n], shifts[n], time).items():
            partials[n, k] = c
    places = {key: f"_p{j}" for j, key in enumerate(partials)}
    agg = df.groupBy(*by).agg(*(c.alias(places[key]) for key, c in partials.items()))
    out = []
    for n, s in stats.items():
        own = {k: F.col(places[m, k]) for m, k in places if m == n}
        out.append(merged_fields(s.state(own, time)).alias(n))
    return agg.select(*by, *out)


def merge(parts: list[DataFrame], stats: Mapping[str, Stat], by: list[str] = (), as_of: int | Column | None = None) -> DataFrame:
    """One table of states from several of the same statistics. A statistic that a part
    lacks is skipped there. There are as many states a group as parts, so folding them in
    an array is bounded."""
    _flat(stats)
    by, time = list(by), as_time(as_of)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    if time is None and any(getattr(s, "timed", False) for s in stats.values()):
        name = next(n for n, s in stats.items() if getattr(s, "timed", False))
        time = F.lit(every.agg(F.max(named(name)["ts"])).first()[0]).cast("long")
    lists = every.groupBy(*by).agg(*(F.collect_list(named(n)).alias(n) for n in stats))
    return lists.select(*by, *(merged_fields(s.fold(named(n), time)).alias(n) for n, s in stats.items()))


def read(state: DataFrame, stats: Mapping[str, Stat], by: list[str] = ()) -> DataFrame:
    """The results of states: by columns and a struct for each statistic."""
    out = []
    for n, s in stats.items():
        fields = state.schema[n].dataType.names
        own = {k: named(n)[k] for k in fields}
        out.append(merged_fields(s.results(s.fields(own, None))).alias(n))
    return state.select(*by, *out)


def aggregate(events: Events, stat: Stat | Mapping[str, Stat], by: list[str] = (), as_of: int | None = None, shift: float | None = None) -> DataFrame:
    """Results of one statistic (its fields as columns) or of several (a struct each)."""
    if isinstance(stat, Stat):
        out = aggregate(events, {"result": stat}, by, as_of, shift)
        return out.select(*by, "result.*")
    return read(states(events, stat, by, as_of, shift), stat, by)


def state_of(events: Events, stat, by: list[str] = (), as_of: int | Column | None = None, shift: float | None = None):
    """The state of a statistic or group of any kind."""
    if stat.kind == "flat":
        return states(events, {STATE: stat}, by, as_of, shift)
    if stat.kind == "keyed":
        return stat.cells(events, by)
    if stat.kind == "group":
        return stat.states(events, by, as_of, shift)
    return stat.state(events, by, as_of)


def merge_of(parts: list, stat, by: list[str] = (), as_of: int | Column | None = None, order: Column | None = None):
    """One state from several. Statistics whose merge depends on the order take them by
    `order`, a column of the states, or else one part after the other."""
    if stat.kind == "flat":
        return merge(parts, {STATE: stat}, by, as_of)
    if stat.kind == "keyed":
        return stat.merge(parts, by)
    return stat.merge(parts, by, as_of, order)


def read_of(state, stat, by: list[str] = (), as_of: int | Column | None = None) -> DataFrame:
    """by columns and the result's fields: one row a group, or several of statistics whose result is a list."""
    if stat.kind == "flat":
        return read(state, {STATE: stat}, by).select(*by, f"{STATE}.*")
    if stat.kind == "group":
        return stat.read(state, by, as_of)
    rows = stat.read(state, by) if stat.kind == "keyed" else stat.read(state, by, as_of)
    if not stat.mapping:
        return rows
    return rows.select(*by, *(c.alias(n) for n, c in stat.results({c: named(c) for c in rows.columns if c not in by}).items()))


def results(events: Events, stat, by: list[str] = (), as_of: int | None = None, shift: float | None = None) -> DataFrame:
    """What a statistic or group of any kind gives for the events."""
    if as_of is None and stat.kind != "flat" and getattr(stat, "timed", False):
        as_of = events.df.agg(F.max(events.row.ts)).first()[0] or 0
    return read_of(state_of(events, stat, by, as_of, shift), stat, by, as_of)


def per_dimension(events: Events, template, size: int, by: list[str] = (), as_of: int | None = None) -> DataFrame:
    """The statistic template(i) of each element of the vectors: by, dim, the result's fields.
    A vector of another size is an error. All dimensions must have the same kind of
    statistic. If they are alike, with no steps of their own, one grouped plan does for all; else each
    dimension has its own member of one group."""
    from .groups import Vectorized

    every = [template(i) for i in range(size)]
    stat = every[0]
    if any(type(s) is not type(stat) for s in every):
        raise ValueError("dimensions differ in kind: take a Vectorized group, whose results are structs")
    checked = Vectorized.checked(events.row.vector, size)
    if all(not s.steps and not s.mapping and s.parameters() == stat.parameters() for s in every):
        r = events.row
        names = {n: f"_{n}" for n in ("ts", "weight", "seq") if getattr(r, n) is not None}
        flat = events.df.select(*by, *(getattr(r, n).alias(c) for n, c in names.items()), F.posexplode(checked).alias("dim", "_value"))
        row = type(r)(value=F.col("_value"), **{n: F.col(c) for n, c in names.items()})
        return results(Events(flat, row), stat, [*by, "dim"], as_of)
    got = Vectorized(size, template).aggregate(events, by, as_of)
    each = F.array(*(F.struct(F.lit(i).alias("dim"), named(str(i)).alias("r")) for i in range(size)))
    rows = got.select(*by, F.inline(each))
    if rows.schema["r"].dataType.typeName() == "array":  # a list of rows for each dimension
        return rows.select(*by, "dim", F.inline("r"))
    return rows.select(*by, "dim", "r.*")
