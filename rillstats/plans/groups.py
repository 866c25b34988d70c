"""Several statistics of the same events under names, nested if wanted.

Flat members share one aggregate, whatever their depth. Any other member has a plan of its
own; a result that is a list comes back as an array in the member's field. A group is a
statistic itself: adapters apply to all its members, it has states that merge, and windows."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import run
from .stat import Events, Stat


def stat(name: str, declaration: Stat) -> tuple[str, Stat]:
    return name, declaration


def group(name: str, *members) -> tuple[str, StatGroup]:
    return name, StatGroup(*members)


#: The name of the table that all flat members share.
FLAT = ""


@dataclass(frozen=True)
class Tables:
    """A group's state: one table for the flat members and one for each other member."""

    tables: dict[str, DataFrame]

    def each(self, f: Callable[[DataFrame], DataFrame]) -> Tables:
        return Tables({n: f(t) for n, t in self.tables.items()})


def _adapter(name: str):
    def adapt(self, *args, **more):
        return self.over(lambda m: getattr(m, name)(*args, **more))

    adapt.__name__, adapt.__doc__ = name, f"{name} of every member."
    return adapt


class StatGroup:
    """Members are (name, statistic) or (name, group). Names must differ and all statistics
    must read the same kind of event."""

    kind = "group"

    def __init__(self, *members: tuple[str, object]):
        names = [n for n, _ in members]
        if len(set(names)) != len(names):
            raise ValueError("two members have one name")
        self.members: dict[str, Stat | StatGroup] = dict(members)
        self.mapping: tuple[Callable[[dict[str, Column]], dict[str, Column]], ...] = ()
        kinds = {s.modality for s in self.leaves().values()}
        if len(kinds) > 1:
            raise ValueError(f"members read different events: {sorted(kinds)}")

    @property
    def modality(self) -> str:
        return next(iter(self.leaves().values())).modality

    @property
    def timed(self) -> bool:
        return any(getattr(s, "timed", False) for s in self.leaves().values())

    def leaves(self, at: tuple[str, ...] = ()) -> dict[tuple[str, ...], Stat]:
        out: dict[tuple[str, ...], Stat] = {}
        for n, m in self.members.items():
            out |= m.leaves((*at, n)) if isinstance(m, StatGroup) else {(*at, n): m}
        return out

    def over(self, f: Callable) -> StatGroup:
        """The group of f(member)."""
        out = copy.copy(self)
        out.members = {n: m.over(f) if isinstance(m, StatGroup) else f(m) for n, m in self.members.items()}
        return out

    filter, locked, with_weight = _adapter("filter"), _adapter("locked"), _adapter("with_weight")
    transform_value, with_value, as_series, as_discrete = _adapter("transform_value"), _adapter("with_value"), _adapter("as_series"), _adapter("as_discrete")
    transform_pair, transform_x, transform_y, transform_vector = _adapter("transform_pair"), _adapter("transform_x"), _adapter("transform_y"), _adapter("transform_vector")
    at_x, at_y, at_index, at_indices = _adapter("at_x"), _adapter("at_y"), _adapter("at_index"), _adapter("at_indices")
    with_time_as_x, with_time_as_y, with_fixed_x, with_fixed_y = _adapter("with_time_as_x"), _adapter("with_time_as_y"), _adapter("with_fixed_x"), _adapter("with_fixed_y")
    fold_vector, fold_paired = _adapter("fold_vector"), _adapter("fold_paired")

    def map_result(self, forward: Callable[[dict[str, Column]], dict[str, Column]]) -> StatGroup:
        """Rewrites the columns of the members' results."""
        out = copy.copy(self)
        out.mapping = (*self.mapping, forward)
        return out

    def _names(self, *kinds: str) -> dict[tuple[str, ...], str]:
        return {path: "/".join(path).replace("`", "'") for path, s in self.leaves().items() if s.kind in kinds}

    def _flat(self) -> dict[str, Stat]:
        leaves = self.leaves()
        return {n: leaves[p] for p, n in self._names("flat").items()}

    def _others(self) -> dict[str, Stat]:
        leaves = self.leaves()
        return {n: leaves[p] for p, n in self._names("keyed", "ordered").items()}

    def states(self, events: Events, by: list[str] = (), as_of: int | Column | None = None, shift: float | None = None) -> Tables:
        if as_of is None and self.timed:
            as_of = events.df.agg(F.max(events.row.ts)).first()[0] or 0
        out = {FLAT: run.states(events, self._flat(), by, as_of, shift)} if self._flat() else {}
        return Tables(out | {n: run.state_of(events, s, by, as_of) for n, s in self._others().items()})

    def merge(self, parts: list[Tables], by: list[str] = (), as_of: int | Column | None = None, order: Column | None = None) -> Tables:
        """A member that a part lacks is skipped there."""
        held = lambda n: [p.tables[n] for p in parts if n in p.tables]
        out = {FLAT: run.merge(held(FLAT), self._flat(), by, as_of)} if self._flat() and held(FLAT) else {}
        return Tables(out | {n: run.merge_of(held(n), s, by, as_of, order) for n, s in self._others().items() if held(n)})

    def read(self, state: Tables, by: list[str] = (), as_of: int | Column | None = None) -> DataFrame:
        """by columns and a column for each member that the state has: a struct, nested for
        groups; an array of structs where the result is a list (null if it is empty)."""
        by, out, names = list(by), None, {}
        if FLAT in state.tables:
            held = {n: s for n, s in self._flat().items() if n in state.tables[FLAT].columns}
            out = run.read(state.tables[FLAT], held, by)
            names = {p: n for p, n in self._names("flat").items() if n in held}
        for path, n in self._names("keyed", "ordered").items():
            if n not in state.tables:
                continue
            s = self.leaves()[path]
            rows = run.read_of(state.tables[n], s, by, as_of)
            fields = F.struct(*(run.named(c) for c in rows.columns if c not in by))
            own = rows.select(*by, fields.alias(n)) if s.single else rows.groupBy(*by).agg(F.collect_list(fields).alias(n))
            names[path] = n
            out = own if out is None else self._beside(out, own, by)
        return self._nested(out, by, names)

    @staticmethod
    def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        """Keys of either: a member may have taken in nothing where another has."""
        if not by:
            return a.crossJoin(F.broadcast(b))  # one row
        none = lambda df, other: [F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns if c not in by]
        rows = a.select(*a.columns, *none(a, b)).unionByName(b.select(*b.columns, *none(b, a)))
        return rows.groupBy(*by).agg(*(F.first(run.named(c), True).alias(c) for c in rows.columns if c not in by))

    def aggregate(self, events: Events, by: list[str] = (), as_of: int | None = None, shift: float | None = None) -> DataFrame:
        """by columns and a column for each member, as read() gives them."""
        if as_of is None and self.timed:
            as_of = events.df.agg(F.max(events.row.ts)).first()[0] or 0
        return self.read(self.states(events, by, as_of, shift), by, as_of)

    def rows(self, events: Events, by: list[str] = (), as_of: int | None = None) -> DataFrame:
        """by, pos, name, result: the JSON form, since results differ in their fields."""
        got = self.aggregate(events, by, as_of)
        each = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), F.to_json(run.named(n)).alias("result")) for k, n in enumerate(self.members)))
        return got.select(*by, F.explode(each).alias("r")).select(*by, "r.*")

    def _nested(self, df: DataFrame, by, names: dict[tuple[str, ...], str]) -> DataFrame:
        def build(g: StatGroup, at: tuple[str, ...]) -> dict[str, Column]:
            out = {}
            for n, m in g.members.items():
                if isinstance(m, StatGroup):
                    if own := build(m, (*at, n)):
                        out[n] = F.struct(*(c.alias(k) for k, c in own.items()))
                elif (*at, n) in names:
                    out[n] = run.named(names[(*at, n)])
            for f in g.mapping:
                out = f(out)
            return out

        return df.select(*by, *(c.alias(n) for n, c in build(self, ()).items()))


class ListStats(StatGroup):
    """Statistics in order, named by themselves unless names are given."""

    def __init__(self, *stats: Stat | tuple[str, Stat]):
        super().__init__(*(s if isinstance(s, tuple) else (type(s).__name__, s) for s in stats))

    def merge(self, parts: list[Tables], by: list[str] = (), as_of: int | Column | None = None, order: Column | None = None) -> Tables:
        """Lists merge by position, so every part has all members."""
        wanted = {*self._flat(), *self._others()}
        for p in parts:
            if {n for t, df in p.tables.items() for n in (df.columns if t == FLAT else [t]) if n not in by} != wanted:
                raise ValueError("the lists differ in their members")
        return super().merge(parts, by, as_of, order)


class Vectorized(StatGroup):
    """The statistic template(i) of each element i of vectors of one size, which may differ in
    kind. Members are named by their place. A vector of another size is an error."""

    def __init__(self, size: int, template: Callable[[int], Stat]):
        at = lambda i: template(i).at_index(i).transform_vector(lambda v: self.checked(v, size))
        super().__init__(*((str(i), at(i)) for i in range(size)))

    @staticmethod
    def checked(vector: Column, size: int) -> Column:
        return F.when(F.size(vector) == size, vector).otherwise(F.raise_error(F.lit(f"vectors must have {size} elements")).cast("array<double>"))


class StatSchema:
    """Members by attribute: statistics, and nested schemas or groups.

        class Traffic(StatSchema):
            requests = Count()
            size = Mean()
    """

    @classmethod
    def group(cls) -> StatGroup:
        found: list[tuple[str, object]] = []
        for base in reversed(cls.__mro__):
            for n, m in vars(base).items():
                if isinstance(m, type) and issubclass(m, StatSchema):
                    found.append((n, m.group()))
                elif isinstance(m, (Stat, StatGroup)):
                    found.append((n, m))
        return StatGroup(*found)


def by_position(results: Mapping[str, object]) -> dict[str, object]:
    """Names "0", "1", ... for results without names."""
    return {str(k): v for k, v in enumerate(results.values())}
