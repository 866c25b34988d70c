"""Statistics that depend on the order of arrival, or that no grouped aggregate can say.

A key's events are cut into ranges of the sequence, so no task gets a key as a whole: EwmaMean
and EwmaVariance are linear in their state, and ranges' sums are joined in order; CounterRate
gives each range the last sample that counts before it. FrugalQuantile and the faithful
SpaceSaving fold the events of a group in order in one Python function per group, so one
group's events go to one task: by nature these don't spread out. TDigest and
SpaceSaving's exact form, and the reservoir, do spread: they are reduced in every
partition before the shuffle.

Each has

    state(events, by, as_of)            a table of states
    merge([state, ...], by, as_of, order)   one of several, in order
    read(state, by, as_of)              results
    of(events, by, as_of)               results of events
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.run import STATE, as_time, join_by
from ..plans.stat import Events, Stat, merged_fields
from .keyed import PROBABILITIES, with_random_key


class Ordered(Stat):
    kind = "ordered"
    #: Whether events must have a sequence column.
    needs_seq = True

    def _events(self, events: Events, by: list[str], **more: Column) -> DataFrame:
        r = self.rows(events.row)
        df = events.df if r.accept is None else events.df.where(r.accept)
        return df.select(*by, r.value.alias("_v"), r.w.alias("_w"), *(c.alias(n) for n, c in more.items()))

    def _need_seq(self, events: Events) -> Column:
        if events.row.seq is None:
            raise ValueError(f"{type(self).__name__} needs a sequence column")
        return events.row.seq

    def of(self, events: Events, by: list[str] = (), as_of: int | None = None) -> DataFrame:
        if as_of is None and getattr(self, "timed", False):
            as_of = events.df.agg(F.max(events.row.ts)).first()[0] or 0
        return self.read(self.state(events, by, as_of), by, as_of)


#: Events of a range of the sequence, about, where its numbers are spread evenly.
RANGE_EVENTS = 1_000_000


def ranged(df: DataFrame) -> DataFrame:
    """df with _range: which of some equal stretches of all sequence numbers a row's _seq lies
    in. Stretches are fixed by the least, the largest and the number of rows."""
    r = df.agg(F.min("_seq").cast("double").alias("lo"), F.max("_seq").cast("double").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    ranges = math.ceil(r["n"] / RANGE_EVENTS)
    if ranges < 2 or r["hi"] <= r["lo"]:
        return df.withColumn("_range", F.lit(0))
    at = F.floor((F.col("_seq").cast("double") - F.lit(r["lo"])) / F.lit(r["hi"] - r["lo"]) * F.lit(ranges))
    return df.withColumn("_range", F.least(F.coalesce(at, F.lit(0)), F.lit(ranges - 1)).cast("int"))


def _whole(by: list[str]):
    return list(by) if by else [F.lit("")]


class Scalar(Ordered):
    """State: a struct of a few numbers in the column `state`, one row a group. Without by
    columns there is always a row."""

    single = True

    def fold(self, states: Column, as_of: Column | None) -> dict[str, Column]:
        """The state of an array of states, in order."""
        raise NotImplementedError

    def fields(self, s: Column, as_of: Column | None) -> dict[str, Column]:
        raise NotImplementedError

    def nothing(self, as_of: Column | None) -> dict[str, Column]:
        """The state of no events."""
        raise NotImplementedError

    def _states(self, df: DataFrame, by: list[str], as_of) -> DataFrame:
        """A row where there is none and no by columns."""
        if by:
            return df
        one = df.sparkSession.range(1).join(F.broadcast(df), F.lit(True), "left")
        return one.select(F.coalesce(STATE, merged_fields(self.nothing(as_time(as_of)))).alias(STATE))

    def merge(self, states: list[DataFrame], by: list[str] = (), as_of: int | Column | None = None, order: Column | None = None) -> DataFrame:
        """A group has as many states as parts, so folding them in an array is bounded."""
        by, every = list(by), None
        for k, s in enumerate(states):
            one = s.select(*by, F.struct(F.lit(k).alias("part"), (F.lit(0) if order is None else order).cast("long").alias("order")).alias("_at"), STATE)
            every = one if every is None else every.unionByName(one)
        lists = every.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_at", STATE))).alias("_s"))
        got = lists.select(*by, F.transform("_s", lambda x: x[STATE]).alias("_s"))
        time = as_time(as_of)
        out = got.select(*by, F.when(F.size("_s") > 0, merged_fields(self.fold(F.col("_s"), time))).alias(STATE))
        return self._states(out, by, as_of)

    def read(self, state: DataFrame, by: list[str] = (), as_of: int | Column | None = None) -> DataFrame:
        return state.select(*by, *(c.alias(n) for n, c in self.fields(F.col(STATE), as_time(as_of)).items()))


class CounterRate(Scalar):
    """Rate of a counter that only grows. A smaller sample is a reset and counts as its own
    value (or as nothing); samples whose time is not after all earlier ones are dropped, and
    so are NaN samples. Merged states add up; what lies between them isn't counted."""

    timed = True

    def __init__(self, decrease_is_reset: bool = True):
        super().__init__()
        self.decrease_is_reset = decrease_is_reset

    def state(self, events: Events, by: list[str] = (), as_of: int | Column | None = None) -> DataFrame:
        r, by = self.rows(events.row), list(by)
        df = self._events(events, by, _ts=r.ts, _seq=self._need_seq(events)).where(~F.isnan("_v"))
        if as_of is None:
            as_of = events.df.agg(F.max(r.ts)).first()[0] or 0
        cut = ranged(df)
        # A range's newest sample, and before each range the newest of those before: that is the
        # last one that counts. It stands first in the range and adds nothing itself.
        newest = cut.groupBy(*by, "_range").agg(F.max(F.struct("_ts", (-F.col("_seq")).alias("o"), "_v")).alias("_p"))
        earlier = Window.partitionBy(*_whole(by)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = F.max(F.struct(F.col("_p._ts"), (-F.col("_range")).alias("o"), F.col("_p._v"))).over(earlier)
        leads = newest.withColumn("_c", carried).where("_c is not null").select(*by, F.col("_c._v"), F.lit(0.0).alias("_w"), F.col("_c._ts"), F.lit(None).cast(cut.schema["_seq"].dataType).alias("_seq"), "_range")
        df = cut.unionByName(leads)
        order = Window.partitionBy(*by, "_range").orderBy(F.asc_nulls_first("_seq"))
        late = F.max("_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
        kept = df.withColumn("_late", late).where(F.col("_late").isNull() | (F.col("_ts") > F.col("_late")))
        before, since = F.lag("_v").over(order), F.lag("_ts").over(order)
        kept = kept.withColumn("_before", before).withColumn("_since", since)
        reset = F.col("_v") < F.col("_before")
        grown = F.when(reset, F.col("_v") if self.decrease_is_reset else F.lit(0.0)).otherwise(F.col("_v") - F.col("_before"))
        delta = F.coalesce(F.greatest(grown * F.col("_w"), F.lit(0.0)), F.lit(0.0))
        each = kept.withColumn("_delta", delta).withColumn("_start", F.when(F.col("_delta") > 0, F.when(reset, F.col("_ts")).otherwise(F.col("_since"))))
        first = F.min_by("_start", F.when(F.col("_start").isNotNull(), F.col("_seq")))
        got = each.groupBy(*by).agg(F.coalesce(F.sum("_delta"), F.lit(0.0)).alias("total"), first.alias("start"))
        return self._states(got.select(*by, F.struct("total", "start", as_time(as_of).alias("ts")).alias(STATE)), by, as_of)

    def nothing(self, as_of):
        return {"total": F.lit(0.0), "start": F.lit(None).cast("long"), "ts": F.coalesce(as_of, F.lit(0).cast("long")) if as_of is not None else F.lit(0).cast("long")}

    def fold(self, states, as_of):
        live = F.filter(states, lambda s: s["total"] != 0)
        last = F.array_max(F.transform(states, lambda s: s["ts"]))
        return {"total": F.aggregate(states, F.lit(0.0), lambda a, s: a + s["total"]), "start": F.array_min(F.transform(live, lambda s: s["start"])), "ts": last if as_of is None else as_of}

    def fields(self, s, as_of):
        now = s["ts"] if as_of is None else as_of
        start = F.coalesce(s["start"], now)
        seconds = (now - start) / F.lit(1e9)
        return {"total_value": s["total"], "start_timestamp_nanos": start, "timestamp_nanos": now, "rate": F.when(seconds > 0, s["total"] / F.when(seconds > 0, seconds)).otherwise(F.lit(0.0))}


class _Ewma(Scalar):
    """Exponentially weighted sums on a clock of weights. With shares a = 1 - exp(-alpha * w) and
    what later weights leave of an event, the mean is the sum of shares times values; the
    variance's recursion M <- (1 - a) (M + a d^2) gives the like sum of squares less the mean's square.
    Both are linear in what came before, so sums of ranges of the order are joined by
    old * exp(-alpha * later weights) + new."""

    def __init__(self, alpha: float):
        super().__init__()
        self.alpha = alpha

    def _left(self, w: Column) -> Column:
        return F.exp(F.lit(-self.alpha) * w)

    def _correction(self, w: Column) -> Column:
        return F.lit(1.0) - self._left(w)

    def _sums(self, events: Events, by: list[str], powers: dict[str, Column]) -> DataFrame:
        """by, total_weights and the sums of powers, of columns of _events."""
        df = self._events(events, by, _seq=self._need_seq(events))
        dealt = ranged(df)
        later = Window.partitionBy(*by, "_range").orderBy(F.desc("_seq")).rowsBetween(Window.unboundedPreceding, -1)
        share = self._correction(F.col("_w")) * self._left(F.coalesce(F.sum("_w").over(later), F.lit(0.0)))
        own = dealt.withColumn("_share", share)
        parts = own.groupBy(*by, "_range").agg(F.sum("_w").alias("w"), *(F.sum(F.col("_share") * c).alias(n) for n, c in powers.items()))
        listed = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_range", "w", *powers))).alias("_s"))
        none = F.struct(F.lit(0.0).alias("w"), *(F.lit(0.0).alias(n) for n in powers))
        joined = F.aggregate("_s", none, lambda a, s: F.struct((a["w"] + s["w"]).alias("w"), *((a[n] * self._left(s["w"]) + s[n]).alias(n) for n in powers)))
        return listed.select(*by, joined.alias("_j")).select(*by, "_j.*")

    def nothing(self, as_of):
        return {n: F.lit(0.0) for n in self.names}


class EwmaMean(_Ewma):
    """Exponentially weighted mean on a clock of weights, corrected for its start. States merge
    by what their weights come to on that clock, one after the other; that isn't the result of
    the joined events."""

    names = ("total_weights", "biased")

    def state(self, events: Events, by: list[str] = (), as_of=None) -> DataFrame:
        by = list(by)
        sums = self._sums(events, by, {"biased": F.col("_v")})
        return self._states(sums.select(*by, F.struct(F.col("w").alias("total_weights"), "biased").alias(STATE)), by, as_of)

    def _mean(self, s: Column) -> Column:
        c = self._correction(s["total_weights"])
        return F.when(c != 0, s["biased"] / F.when(c != 0, c)).otherwise(F.lit(0.0))

    def fold(self, states, as_of):
        def add(a, s):
            w1, w2 = self._correction(a["total_weights"]), self._correction(s["total_weights"])
            mean = (a["mean"] * w1 + self._mean(s) * w2) / F.when(w1 + w2 != 0, w1 + w2)
            return F.struct((a["total_weights"] + s["total_weights"]).alias("total_weights"), F.coalesce(mean, a["mean"]).alias("mean"))

        none = F.struct(F.lit(0.0).alias("total_weights"), F.lit(0.0).alias("mean"))
        got = F.aggregate(states, none, add)
        return {"total_weights": got["total_weights"], "biased": got["mean"] * self._correction(got["total_weights"])}

    def fields(self, s, as_of):
        return {"total_weights": s["total_weights"], "mean": self._mean(s)}


class EwmaVariance(_Ewma):
    """Exponentially weighted mean and variance on a clock of weights, corrected for their start.
    States merge like those of EwmaMean. Squares are of distances from `shift`, a number near
    the data; without one the mean of all events is taken first."""

    names = ("total_weights", "mean", "variance")

    def __init__(self, alpha: float, shift: float | None = None):
        super().__init__(alpha)
        self.shift = shift

    def state(self, events: Events, by: list[str] = (), as_of=None) -> DataFrame:
        by, shift = list(by), self.shift
        if shift is None:
            shift = self._events(events, []).agg(F.avg("_v")).first()[0] or 0.0
        u = F.col("_v") - F.lit(float(shift))
        sums = self._sums(events, by, {"s1": u, "s2": u * u})
        c = F.lit(float(shift))
        left, correction = self._left(F.col("w")), self._correction(F.col("w"))
        # The start is a value 0 whose share is what all weights leave.
        mean = F.col("s1") - left * c
        biased_m2 = F.greatest(F.col("s2") + left * c * c - mean * mean, F.lit(0.0))
        ok = F.when(correction != 0, correction)
        one = F.struct(F.col("w").alias("total_weights"), F.coalesce((mean + c) / ok, F.lit(0.0)).alias("mean"), F.coalesce(biased_m2 / ok, F.lit(0.0)).alias("variance"))
        return self._states(sums.select(*by, one.alias(STATE)), by, as_of)

    def fold(self, states, as_of):
        def add(a, s):
            w1, w2 = self._correction(a["total_weights"]), self._correction(s["total_weights"])
            both, d = F.when(w1 + w2 != 0, w1 + w2), a["mean"] - s["mean"]
            mean = (a["mean"] * w1 + s["mean"] * w2) / both
            variance = (w1 * a["variance"] + w2 * s["variance"] + w1 * w2 * d * d / both) / both
            live = (s["total_weights"] > 0) & both.isNotNull()
            joined = F.struct((a["total_weights"] + s["total_weights"]).alias("total_weights"), mean.alias("mean"), variance.alias("variance"))
            return F.when(live, joined).otherwise(a)

        none = F.struct(*(F.lit(0.0).alias(n) for n in self.names))
        got = F.aggregate(states, none, add)
        return {n: got[n] for n in self.names}

    def fields(self, s, as_of):
        return {n: s[n] for n in self.names}


class FrugalQuantile(Scalar):
    """A quantile by one number that steps toward it. A merge is the mean of the number so far
    and the next state's, one after the other."""

    names = ("quantile",)

    def __init__(self, q: float, step: float = 0.01, initial: float = 0.0):
        super().__init__()
        if not 0 < q < 1:
            raise ValueError("q must lie between 0 and 1")
        self.q, self.step, self.initial = q, step, initial

    def walk(self, value: np.ndarray, weight: np.ndarray) -> float:
        at = self.initial
        for v in value[weight > 0].tolist():
            if v > at:
                at += self.step * self.q
            elif v < at:
                at -= self.step * (1 - self.q)
        return at

    def state(self, events: Events, by: list[str] = (), as_of=None) -> DataFrame:
        by = list(by)
        df = self._events(events, by, _seq=self._need_seq(events))
        walk = self.walk

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_seq", kind="stable")
            return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, "quantile": walk(pdf["_v"].to_numpy(), pdf["_w"].to_numpy(float))}])

        keys = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
        got = df.groupBy(*_whole(by)).applyInPandas(run, f"{keys}quantile double")
        return self._states(got.select(*by, F.struct("quantile").alias(STATE)), by, as_of)

    def nothing(self, as_of):
        return {"quantile": F.lit(float(self.initial))}

    def fold(self, states, as_of):
        rest = F.slice(states, 2, F.greatest(F.size(states), F.lit(1)))
        return {"quantile": F.aggregate(rest, F.get(states, F.lit(0))["quantile"], lambda a, s: (a + s["quantile"]) / 2)}

    def fields(self, s, as_of):
        return {"probability": F.lit(self.q), "quantile": s["quantile"]}


class Listed(Ordered):
    """State: rows that are the result as well."""

    needs_seq = False

    def read(self, state: DataFrame, by: list[str] = (), as_of=None) -> DataFrame:
        return state


class SpaceSaving(Listed):
    """Heavy hitters. state() counts exactly and keeps the `capacity` largest, which meets the
    sketch's bounds with error 0; faithful() gives the evicting sketch."""

    modality = "discrete"

    def __init__(self, capacity: int):
        super().__init__()
        self.capacity = capacity

    def _live(self, events: Events, by, **more) -> DataFrame:
        return self._events(events, by, **more).withColumn("_w", F.col("_w").cast("long")).where("_w >= 1")

    def state(self, events: Events, by: list[str] = (), as_of=None) -> DataFrame:
        by = list(by)
        sums = self._live(events, by).groupBy(*by, F.col("_v").alias("key")).agg(F.sum("_w").alias("count"))
        if not by:
            return sums.orderBy(F.desc("count"), "key").limit(self.capacity).withColumn("error", F.lit(0).cast("long"))
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "key"))
        return sums.withColumn("_n", place).where(F.col("_n") <= self.capacity).drop("_n").withColumn("error", F.lit(0).cast("long"))

    def merge(self, results: list[DataFrame], by: list[str] = (), as_of=None, order: Column | None = None) -> DataFrame:
        every = results[0]
        for r in results[1:]:
            every = every.unionByName(r)
        sums = every.groupBy(*by, "key").agg(F.sum("count").alias("count"), F.sum("error").alias("error"))
        place = F.row_number().over(Window.partitionBy(*_whole(list(by))).orderBy(F.desc("count"), "key"))
        return sums.withColumn("_n", place).where(F.col("_n") <= self.capacity).drop("_n")

    def faithful(self) -> EvictingSpaceSaving:
        """The sketch itself, with the same steps."""
        out = EvictingSpaceSaving(self.capacity)
        out.steps, out.modality, out.mapping = self.steps, self.modality, self.mapping
        return out


class EvictingSpaceSaving(SpaceSaving):
    """Heavy hitters by the evicting sketch on each group in order. A key that isn't held takes
    the first of the least-counted places, whose count becomes its error. Merging takes in the
    places of one state after the other in the same way. By nature a group is one task."""

    needs_seq = True

    def _admitted(self, keys, counts, errors) -> pd.DataFrame:
        held, at = 0, {}
        key, count, error = np.zeros(self.capacity, np.int64), np.zeros(self.capacity, np.int64), np.zeros(self.capacity, np.int64)
        for k, c, e in zip(keys, counts, errors):
            place = at.get(k)
            if place is None:
                if held < self.capacity:
                    place, held = held, held + 1
                else:
                    place = int(count.argmin())
                    least = int(count[place])
                    del at[int(key[place])]
                    error[place] = least
                    count[place] = least
                at[k], key[place] = place, k
            count[place] += c
            error[place] += e
        return pd.DataFrame({"key": key[:held], "count": count[:held], "error": error[:held], "place": np.arange(held)})

    def _folded(self, df: DataFrame, by: list[str], order: list[str], columns: tuple[str, ...]) -> DataFrame:
        admitted = self._admitted

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable")
            out = admitted(*(pdf[c].tolist() for c in columns))
            for j, b in enumerate(by):
                out.insert(j, b, pdf[b].iloc[0])
            return out

        keys = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
        return df.groupBy(*_whole(by)).applyInPandas(run, f"{keys}key long, count long, error long, place long")

    def state(self, events: Events, by: list[str] = (), as_of=None) -> DataFrame:
        """by, key, count, error, place."""
        by = list(by)
        df = self._live(events, by, _seq=self._need_seq(events)).withColumn("_e", F.lit(0).cast("long"))
        return self._folded(df, by, ["_seq"], ("_v", "_w", "_e"))

    def merge(self, results: list[DataFrame], by: list[str] = (), as_of=None, order: Column | None = None) -> DataFrame:
        """As many rows of a group come together as parts have places."""
        every = None
        for k, s in enumerate(results):
            one = s.select(*by, "key", "count", "error", "place", F.lit(k).alias("_part"), (F.lit(0) if order is None else order).cast("long").alias("_order"))
            every = one if every is None else every.unionByName(one)
        return self._folded(every, list(by), ["_part", "_order", "place"], ("key", "count", "error"))

    def read(self, state: DataFrame, by: list[str] = (), as_of=None) -> DataFrame:
        return state.drop("place")


class ReservoirHistogram(Listed):
    """A weighted sample without replacement: the `capacity` largest keys u^(1/w). u is a hash of
    the row's whole-numbered id, so the sample doesn't depend on partitions, and merging is the same top-k."""

    def __init__(self, capacity: int = 1024, seed: int = 0):
        super().__init__()
        self.capacity, self.seed = capacity, seed

    def state(self, events: Events, by: list[str] = (), as_of=None) -> DataFrame:
        by = list(by)
        df = self._events(events, by, _id=self._need_seq(events)).where((F.col("_w") > 0) & ~F.isnan("_v"))
        drawn = with_random_key(df, self.seed, F.col("_id"), "_u")
        keyed = drawn.select(*by, F.col("_v").alias("value"), F.pow("_u", F.lit(1.0) / F.col("_w")).alias("key"))
        return self.merge([keyed], by)

    def merge(self, samples: list[DataFrame], by: list[str] = (), as_of=None, order: Column | None = None) -> DataFrame:
        every = samples[0]
        for s in samples[1:]:
            every = every.unionByName(s)
        if not by:
            return every.select("value", "key").orderBy(F.desc("key"), "value").limit(self.capacity)
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("key"), "value"))
        return every.withColumn("_n", place).where(F.col("_n") <= self.capacity).drop("_n")

    @staticmethod
    def quantile(sample: DataFrame, p: float, by: list[str] = ()) -> DataFrame:
        """Interpolated between neighbours; NaN of nothing."""
        return sample.groupBy(*by).agg(F.coalesce(F.percentile("value", F.lit(p)), F.lit(math.nan)).alias("quantile"))

    @staticmethod
    def histogram(sample: DataFrame, bins: int, by: list[str] = ()) -> DataFrame:
        """Bins of equal width from the smallest to the largest value, those that hold something;
        one bin without width if all are equal."""
        ends = sample.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        wide = join_by(sample, ends, list(by))
        width = (F.col("_hi") - F.col("_lo")) / bins
        idx = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(F.lit(0))
        return wide.select(*by, idx.alias("_k"), "_lo", width.alias("_width")).groupBy(*by, "_k", "_lo", "_width").agg(F.count(F.lit(1)).cast("double").alias("weight")).select(
            *by, (F.col("_lo") + F.col("_k") * F.col("_width")).alias("lower_bound"), (F.col("_lo") + (F.col("_k") + 1) * F.col("_width")).alias("upper_bound"), "weight"
        )


def compressed(mean: np.ndarray, weight: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids in order, joined where their middles lie in one step of the arcsine scale: a
    sort, running sums and a cut, so there are compression / 2 + 1 at most."""
    if not len(mean):
        return mean, weight
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    middle = (np.cumsum(weight) - weight / 2) / weight.sum()
    step = np.floor(compression / (2 * np.pi) * np.arcsin(np.clip(2 * middle - 1, -1, 1)))
    first = np.concatenate([[0], np.nonzero(np.diff(step))[0] + 1])
    weights = np.add.reduceat(weight, first)
    return np.add.reduceat(mean * (weight / np.repeat(weights, np.diff(np.append(first, len(mean))))), first), weights


def interpolated(mean: np.ndarray, weight: np.ndarray, p: float) -> float:
    if not len(mean):
        return 0.0
    centre = np.cumsum(weight) - weight / 2
    return float(np.interp(p * weight.sum(), centre, mean))


class TDigest(Ordered):
    """Quantiles from centroids that are small at the ends. Every partition makes a digest of
    its own for each group; digests of a group are joined."""

    needs_seq = False

    def __init__(self, compression: float = 100.0, probabilities=PROBABILITIES):
        super().__init__()
        self.compression, self.probabilities = compression, tuple(probabilities)

    def state(self, events: Events, by: list[str] = (), as_of=None) -> DataFrame:
        """by, means, weights: one row a group."""
        by, c = list(by), self.compression
        df = self._events(events, by).where((F.col("_w") > 0) & ~F.isnan("_v"))

        def part(batches):
            held: dict = {}
            for pdf in batches:
                groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
                for key, g in groups:
                    key = key if isinstance(key, tuple) else (key,)
                    m, w = held.get(key, (np.empty(0), np.empty(0)))
                    held[key] = compressed(np.concatenate([m, g["_v"].to_numpy()]), np.concatenate([w, g["_w"].to_numpy()]), c)
            if held:
                yield pd.DataFrame([(*k, m.tolist(), w.tolist()) for k, (m, w) in held.items()], columns=[*by, "means", "weights"])

        keys = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
        return self.merge([df.mapInPandas(part, f"{keys}means array<double>, weights array<double>")], by)

    def merge(self, states: list[DataFrame], by: list[str] = (), as_of=None, order: Column | None = None) -> DataFrame:
        """As many centroids come together as partitions or states have made for a group."""
        by, c, every = list(by), self.compression, states[0]
        for s in states[1:]:
            every = every.unionByName(s)
        every = every.select(*by, "means", "weights")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            m, w = compressed(np.concatenate(pdf["means"].to_list()), np.concatenate(pdf["weights"].to_list()), c)
            return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, "means": m.tolist(), "weights": w.tolist()}])

        return every.groupBy(*_whole(by)).applyInPandas(run, every.schema)

    def read(self, state: DataFrame, by: list[str] = (), as_of=None) -> DataFrame:
        ps = self.probabilities

        @F.pandas_udf("array<double>")
        def quantiles(means: pd.Series, weights: pd.Series) -> pd.Series:
            return pd.Series([[interpolated(np.asarray(m), np.asarray(w), p) for p in ps] for m, w in zip(means, weights)])

        got = state.select(*by, F.posexplode(quantiles("means", "weights")).alias("_k", "quantile"))
        return got.select(*by, F.element_at(F.array(*map(F.lit, ps)), F.col("_k") + 1).alias("probability"), "quantile")

    @staticmethod
    def histogram(state: DataFrame, by: list[str] = ()) -> DataFrame:
        """A bin around each centroid, up to the middle between neighbours."""
        each = state.select(*by, F.posexplode(F.arrays_zip("means", "weights")).alias("_k", "_c"), F.col("means").alias("_m"))
        mean, before, after = F.col("_c.means"), F.get("_m", F.col("_k") - 1), F.get("_m", F.col("_k") + 1)
        return each.select(*by, F.coalesce((before + mean) / 2, mean).alias("lower_bound"), F.coalesce((mean + after) / 2, mean).alias("upper_bound"), F.col("_c.weights").alias("weight"))
