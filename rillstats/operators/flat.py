"""Statistics whose state is a few scalars.

Each says which aggregates it needs of a row (`partials`), how they make its state
(`state`), how several states fold into one (`fold`, over an array of state structs), and
what the result is (`fields`). Weighted moments are power sums about a shift near the
data, since raw power sums cancel; without weights Spark's own aggregates are used."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.stat import Row, Stat

Cols = dict[str, Column]


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def over(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0 or less or null."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def total(states: Column, name: str) -> Column:
    return F.aggregate(states, F.lit(0.0), lambda a, s: a + s[name])


class Flat(Stat):
    kind = "flat"
    #: Whether results depend on the time of reading.
    timed = False

    def shifts(self, r: Row) -> Cols:
        """Expressions whose means are the shifts of partials(); none if it needs no shift."""
        return {}

    def partials(self, r: Row, shift: Cols, as_of: Column | None) -> Cols:
        raise NotImplementedError

    def state(self, p: Cols, as_of: Column | None) -> Cols:
        return {k: zero(c) for k, c in p.items()}

    def fold(self, states: Column, as_of: Column | None) -> Cols:
        raise NotImplementedError

    def fields(self, s: Cols, as_of: Column | None) -> Cols:
        return dict(s)


# Summaries


class Sum(Flat):
    """Sum of value * weight; 0 of nothing."""

    def partials(self, r, shift, as_of):
        return {"sum": F.sum(r.kept(r.value if r.weight is None else r.value * r.w))}

    def fold(self, states, as_of):
        return {"sum": total(states, "sum")}


class Count(Flat):
    """Number of events as a double, whatever their value and weight."""

    def partials(self, r, shift, as_of):
        return {"sum": F.count(r.kept(F.lit(1))).cast("double")}

    def fold(self, states, as_of):
        return {"sum": total(states, "sum")}


class TotalWeights(Flat):
    """Sum of weights."""

    def partials(self, r, shift, as_of):
        return {"sum": F.sum(r.kept(r.w))}

    def fold(self, states, as_of):
        return {"sum": total(states, "sum")}


class FixedPointSum(Flat):
    """Sum in whole units of 10^-digits: each addend is cut off, so the order doesn't matter."""

    def __init__(self, digits: int = 6):
        super().__init__()
        self.digits = digits

    def partials(self, r, shift, as_of):
        return {"units": F.sum(r.kept((r.value * r.w * F.lit(10.0**self.digits)).cast("long").cast("decimal(38,0)")))}

    def state(self, p, as_of):
        return {"units": F.coalesce(p["units"], F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")}

    def fold(self, states, as_of):
        return {"units": F.aggregate(states, F.lit(0).cast("decimal(38,0)"), lambda a, s: (a + s["units"]).cast("decimal(38,0)"))}

    def fields(self, s, as_of):
        return {"sum": s["units"].cast("double") / F.lit(10.0**self.digits)}


class Mean(Flat):
    """Weighted mean; events of weight 0 are skipped."""

    def shifts(self, r):
        return {} if r.weight is None else {"s": r.kept(r.value)}

    def partials(self, r, shift, as_of):
        if r.weight is None:
            return {"w": F.count(r.kept(F.lit(1))).cast("double"), "mean": F.avg(r.kept(r.value))}
        d = r.value - shift["s"]
        live = r.only(r.w != 0)
        return {"w": F.sum(live.kept(r.w)), "d1": F.sum(live.kept(r.w * d)), "s": F.first(shift["s"], True)}

    def state(self, p, as_of):
        if "d1" in p:
            return {"w": zero(p["w"]), "mean": zero(F.when(p["w"] != 0, p["s"] + p["d1"] / p["w"]))}
        return {"w": zero(p["w"]), "mean": zero(p["mean"])}

    def fold(self, states, as_of):
        w = total(states, "w")
        return {"w": w, "mean": ratio(F.aggregate(states, F.lit(0.0), lambda a, s: a + s["w"] * s["mean"]), w)}

    def fields(self, s, as_of):
        return {"total_weights": s["w"], "mean": s["mean"]}


def folded_mean(states: Column, w: Column, name: str) -> Column:
    return ratio(F.aggregate(states, F.lit(0.0), lambda a, s: a + s["w"] * s[name]), w)


class Variance(Flat):
    """Weighted population variance; events of weight 0 are skipped."""

    def shifts(self, r):
        return {} if r.weight is None else {"s": r.kept(r.value)}

    def partials(self, r, shift, as_of):
        if r.weight is None:
            v = r.kept(r.value)
            return {"w": F.count(v).cast("double"), "mean": F.avg(v), "var": F.var_pop(v)}
        live, d = r.only(r.w != 0), r.value - shift["s"]
        return {"w": F.sum(live.kept(r.w)), "d1": F.sum(live.kept(r.w * d)), "d2": F.sum(live.kept(r.w * d * d)), "s": F.first(shift["s"], True)}

    def state(self, p, as_of):
        if "var" in p:
            return {"w": zero(p["w"]), "mean": zero(p["mean"]), "m2": zero(p["var"] * p["w"])}
        m = F.when(p["w"] != 0, p["d1"] / p["w"])
        return {"w": zero(p["w"]), "mean": zero(p["s"] + m), "m2": zero(p["d2"] - m * p["d1"])}

    def fold(self, states, as_of):
        w = total(states, "w")
        mean = folded_mean(states, w, "mean")
        m2 = F.element_at(F.transform(F.array(mean), lambda m: F.aggregate(states, F.lit(0.0), lambda a, s: a + s["m2"] + s["w"] * (s["mean"] - m) * (s["mean"] - m))), 1)
        return {"w": w, "mean": mean, "m2": m2}

    def fields(self, s, as_of):
        var = over(s["m2"], s["w"])
        sample = F.when(s["w"] > 1, s["m2"] / (s["w"] - 1)).otherwise(F.lit(0.0))
        return {"total_weights": s["w"], "mean": s["mean"], "variance": var, "sst": s["m2"], "std_dev": F.sqrt(var), "sample_variance": sample, "sample_std_dev": F.sqrt(sample)}


class Moments(Flat):
    """Weighted mean and sums of the second to fourth powers of deviations; events of weight
    0 or less are skipped. With weights these are the exact weighted moments."""

    def shifts(self, r):
        return {} if r.weight is None else {"s": r.kept(r.value)}

    def partials(self, r, shift, as_of):
        if r.weight is None:
            v = r.kept(r.value)
            return {"w": F.count(v).cast("double"), "mean": F.avg(v), "var": F.var_pop(v), "skew": F.skewness(v), "kurt": F.kurtosis(v)}
        live, d = r.only(r.w > 0), r.value - shift["s"]
        out, power = {"w": F.sum(live.kept(r.w)), "s": F.first(shift["s"], True)}, r.w
        for k in range(1, 5):
            power = power * d
            out[f"d{k}"] = F.sum(live.kept(power))
        return out

    def state(self, p, as_of):
        w = zero(p["w"])
        if "var" in p:
            var = zero(p["var"])
            return {"w": w, "mean": zero(p["mean"]), "m2": var * w, "m3": zero(p["skew"] * w * F.pow(var, 1.5)), "m4": zero((p["kurt"] + 3) * w * var * var)}
        m = F.when(p["w"] != 0, p["d1"] / p["w"])
        return {
            "w": w, "mean": zero(p["s"] + m), "m2": zero(p["d2"] - m * p["d1"]), "m3": zero(p["d3"] - 3 * m * p["d2"] + 2 * p["w"] * m * m * m),
            "m4": zero(p["d4"] - 4 * m * p["d3"] + 6 * m * m * p["d2"] - 3 * p["w"] * m * m * m * m),
        }

    def fold(self, states, as_of):
        w = total(states, "w")
        mean = folded_mean(states, w, "mean")

        def about(power):
            def body(m):
                def one(a, s):
                    d = s["mean"] - m
                    terms = {2: s["m2"] + s["w"] * d * d, 3: s["m3"] + 3 * d * s["m2"] + s["w"] * d * d * d, 4: s["m4"] + 4 * d * s["m3"] + 6 * d * d * s["m2"] + s["w"] * d * d * d * d}
                    return a + terms[power]

                return F.aggregate(states, F.lit(0.0), one)

            return F.element_at(F.transform(F.array(mean), body), 1)

        return {"w": w, "mean": mean, "m2": about(2), "m3": about(3), "m4": about(4)}

    def fields(self, s, as_of):
        w, var = s["w"], over(s["m2"], s["w"])
        flat = (w <= 0) | (var <= 0)
        skew = F.when(flat, F.lit(0.0)).otherwise(s["m3"] / w / F.pow(F.when(var > 0, var).otherwise(1.0), 1.5))
        kurt = F.when(flat, F.lit(0.0)).otherwise(s["m4"] / w / F.when(var > 0, var * var).otherwise(1.0) - 3)
        return {
            "total_weights": w, "mean": s["mean"], "m2": s["m2"], "m3": s["m3"], "m4": s["m4"], "variance": var, "skewness": skew, "kurtosis": kurt,
            "unbiased_skewness": F.when((w > 2) & ~flat, skew * F.sqrt(w * (w - 1)) / (w - 2)).otherwise(F.lit(0.0)),
            "unbiased_kurtosis": F.when((w > 3) & ~flat, (w - 1) / ((w - 2) * (w - 3)) * ((w + 1) * kurt + 6)).otherwise(F.lit(0.0)),
        }


def _numbers(r: Row) -> Column:
    return r.only(~F.isnan(r.value)).kept(r.value)


class Min(Flat):
    """Smallest value that is a number, whatever the weight; +Infinity of nothing."""

    def partials(self, r, shift, as_of):
        return {"min": F.min(_numbers(r))}

    def state(self, p, as_of):
        return {"min": F.coalesce(p["min"], F.lit(math.inf))}

    def fold(self, states, as_of):
        return {"min": F.array_min(F.transform(states, lambda s: s["min"]))}


class Max(Flat):
    """Largest value that is a number, whatever the weight; -Infinity of nothing."""

    def partials(self, r, shift, as_of):
        return {"max": F.max(_numbers(r))}

    def state(self, p, as_of):
        return {"max": F.coalesce(p["max"], F.lit(-math.inf))}

    def fold(self, states, as_of):
        return {"max": F.array_max(F.transform(states, lambda s: s["max"]))}


class Range(Flat):
    """Smallest and largest value."""

    def partials(self, r, shift, as_of):
        return {"min": F.min(_numbers(r)), "max": F.max(_numbers(r))}

    def state(self, p, as_of):
        return {"min": F.coalesce(p["min"], F.lit(math.inf)), "max": F.coalesce(p["max"], F.lit(-math.inf))}

    def fold(self, states, as_of):
        return {"min": F.array_min(F.transform(states, lambda s: s["min"])), "max": F.array_max(F.transform(states, lambda s: s["max"]))}


# Decay and rate


def half_life(d: timedelta) -> float:
    """Decay a nanosecond."""
    return math.log(2) / (d / timedelta(microseconds=1) * 1000)


def faded(r: Row, alpha: float, as_of: Column) -> Column:
    """Weight left at the time of reading. Events after it count more than their weight."""
    return r.w * F.exp(F.lit(-alpha) * (as_of - r.ts).cast("double"))


class Decaying(Flat):
    timed = True

    def __init__(self, half: timedelta):
        super().__init__()
        self.alpha = half_life(half)

    def left(self, states: Column, name: str, as_of: Column) -> Column:
        return F.aggregate(states, F.lit(0.0), lambda a, s: a + s[name] * self.age(s, as_of))

    def age(self, s: Column, as_of: Column) -> Column:
        return F.exp(F.lit(-self.alpha) * (as_of - s["ts"]).cast("double"))


class DecayingSum(Decaying):
    """Sum of value * weight, halved for each half-life."""

    def partials(self, r, shift, as_of):
        return {"sum": F.sum(r.kept(r.value * faded(r, self.alpha, as_of)))}

    def state(self, p, as_of):
        return {"sum": zero(p["sum"]), "ts": as_of}

    def fold(self, states, as_of):
        return {"sum": self.left(states, "sum", as_of), "ts": as_of}

    def fields(self, s, as_of):
        return {"sum": s["sum"], "timestamp_nanos": s["ts"]}


class DecayingMean(Decaying):
    """Mean with decaying weights: 0 if they sum to 0, NaN if to less."""

    def partials(self, r, shift, as_of):
        u = faded(r, self.alpha, as_of)
        return {"sum": F.sum(r.kept(r.value * u)), "w": F.sum(r.kept(u))}

    def state(self, p, as_of):
        return {"sum": zero(p["sum"]), "w": zero(p["w"]), "ts": as_of}

    def fold(self, states, as_of):
        return {"sum": self.left(states, "sum", as_of), "w": self.left(states, "w", as_of), "ts": as_of}

    def fields(self, s, as_of):
        mean = F.when(s["w"] > 0, s["sum"] / s["w"]).when(s["w"] < 0, F.lit(math.nan)).otherwise(F.lit(0.0))
        return {"mean": mean, "total_weights": s["w"], "timestamp_nanos": s["ts"]}


class DecayingVariance(Decaying):
    """Population variance with decaying weights; events of weight 0 or less are skipped."""

    def shifts(self, r):
        return {"s": r.kept(r.value)}

    def partials(self, r, shift, as_of):
        u, d, live = faded(r, self.alpha, as_of), r.value - shift["s"], r.only(r.w > 0)
        return {"w": F.sum(live.kept(u)), "d1": F.sum(live.kept(u * d)), "d2": F.sum(live.kept(u * d * d)), "s": F.first(shift["s"], True)}

    def state(self, p, as_of):
        m = F.when(p["w"] > 0, p["d1"] / p["w"])
        return {"w": zero(p["w"]), "mean": zero(p["s"] + m), "m2": zero(p["d2"] - m * p["d1"]), "ts": as_of}

    def fold(self, states, as_of):
        aged = F.transform(states, lambda s: F.struct((s["w"] * self.age(s, as_of)).alias("w"), s["mean"].alias("mean"), (s["m2"] * self.age(s, as_of)).alias("m2")))
        return {**Variance().fold(aged, as_of), "ts": as_of}

    def fields(self, s, as_of):
        var = over(s["m2"], s["w"])
        return {"mean": s["mean"], "variance": var, "std_dev": F.sqrt(var), "total_weights": s["w"], "timestamp_nanos": s["ts"]}


class DecayingRate(DecayingSum):
    """Events a second: the decaying sum times the decay a second."""

    def fields(self, s, as_of):
        rate = s["sum"] * F.lit(self.alpha * 1e9)
        return {"rate": rate, "timestamp_nanos": s["ts"]}

    def fold(self, states, as_of):
        return {"sum": F.aggregate(states, F.lit(0.0), lambda a, s: a + F.greatest(s["sum"], F.lit(0.0)) * self.age(s, as_of)), "ts": as_of}


class Rate(Flat):
    """Sum of value * weight over the seconds from the first event's time to the reading. With
    a sequence column the first event is the first by it, else the earliest."""

    timed = True

    def partials(self, r, shift, as_of):
        first = F.min(r.kept(r.ts)) if r.seq is None else F.min_by(r.kept(r.ts), r.kept(r.seq))
        return {"total": F.sum(r.kept(r.value * r.w)), "start": first}

    def state(self, p, as_of):
        return {"total": zero(p["total"]), "start": F.coalesce(p["start"], as_of), "ts": as_of}

    def fold(self, states, as_of):
        live = F.filter(states, lambda s: s["total"] != 0)
        return {"total": total(states, "total"), "start": F.coalesce(F.array_min(F.transform(live, lambda s: s["start"])), as_of), "ts": as_of}

    def fields(self, s, as_of):
        return {"start_timestamp_nanos": s["start"], "total_value": s["total"], "timestamp_nanos": s["ts"], "rate": over(s["total"], (s["ts"] - s["start"]) / F.lit(1e9))}


def per(rate: Column, d: timedelta) -> Column:
    """A rate a second as a rate a duration."""
    return rate * F.lit(d.total_seconds())


# Regression


class OLS(Flat):
    """Weighted regression of y on x; events of weight 0 or less are skipped. Where x doesn't
    vary the slope is 0 and the intercept the mean of y."""

    modality = "paired"

    def shifts(self, r):
        return {} if r.weight is None else {"sx": r.kept(r.x), "sy": r.kept(r.y)}

    def partials(self, r, shift, as_of):
        if r.weight is None:
            x, y = r.kept(r.x), r.kept(r.y)
            return {"w": F.count(x).cast("double"), "mx": F.avg(x), "my": F.avg(y), "sxx": F.regr_sxx(y, x), "sxy": F.regr_sxy(y, x), "syy": F.regr_syy(y, x)}
        live, dx, dy = r.only(r.w > 0), r.x - shift["sx"], r.y - shift["sy"]
        sums = {"w": r.w, "dx": r.w * dx, "dy": r.w * dy, "dxx": r.w * dx * dx, "dxy": r.w * dx * dy, "dyy": r.w * dy * dy}
        return {k: F.sum(live.kept(c)) for k, c in sums.items()} | {"sx": F.first(shift["sx"], True), "sy": F.first(shift["sy"], True)}

    def state(self, p, as_of):
        if "dx" not in p:
            return {k: zero(c) for k, c in p.items()}
        mx, my = F.when(p["w"] > 0, p["dx"] / p["w"]), F.when(p["w"] > 0, p["dy"] / p["w"])
        return {"w": zero(p["w"]), "mx": zero(p["sx"] + mx), "my": zero(p["sy"] + my), "sxx": zero(p["dxx"] - mx * p["dx"]), "sxy": zero(p["dxy"] - mx * p["dy"]), "syy": zero(p["dyy"] - my * p["dy"])}

    def fold(self, states, as_of):
        w = total(states, "w")
        mx, my = folded_mean(states, w, "mx"), folded_mean(states, w, "my")

        def about(name, a, b, ma, mb):
            both = F.array(F.struct(ma.alias("a"), mb.alias("b")))
            return F.element_at(F.transform(both, lambda m: F.aggregate(states, F.lit(0.0), lambda t, s: t + s[name] + s["w"] * (s[a] - m["a"]) * (s[b] - m["b"]))), 1)

        return {"w": w, "mx": mx, "my": my, "sxx": about("sxx", "mx", "mx", mx, mx), "sxy": about("sxy", "mx", "my", mx, my), "syy": about("syy", "my", "my", my, my)}

    def slope(self, s: Cols) -> Column:
        return over(s["sxy"], s["sxx"])

    def fields(self, s, as_of):
        slope = self.slope(s)
        sse = F.greatest(F.lit(0.0), s["syy"] - 2 * slope * s["sxy"] + slope * slope * s["sxx"])
        r2 = F.when(s["syy"] > 0, 1 - sse / s["syy"]).otherwise(F.lit(0.0))
        mse = over(sse, s["w"])
        return {
            "total_weights": s["w"], "slope": slope, "intercept": s["my"] - slope * s["mx"], "sse": sse, "x": F.struct(s["mx"].alias("mean"), over(s["sxx"], s["w"]).alias("variance")),
            "y": F.struct(s["my"].alias("mean"), over(s["syy"], s["w"]).alias("variance")), "sst": s["syy"], "ssr": s["syy"] - sse, "mse": mse, "rmse": F.sqrt(mse), "r_squared": r2,
            "correlation": F.sqrt(F.greatest(F.lit(0.0), r2)) * F.signum(slope), "covariance": over(slope * s["sxx"], s["w"]),
        }


def predicted(slope: Column, intercept: Column, x: Column) -> Column:
    return slope * x + intercept


class Covariance(OLS):
    """Population covariance and correlation."""

    def fields(self, s, as_of):
        root = F.sqrt(s["sxx"] * s["syy"])
        return {
            "total_weights": s["w"], "mean_x": s["mx"], "mean_y": s["my"], "sxy": s["sxy"], "sxx": s["sxx"], "syy": s["syy"], "covariance": over(s["sxy"], s["w"]), "correlation": over(s["sxy"], root),
            "var_x": over(s["sxx"], s["w"]), "var_y": over(s["syy"], s["w"]),
        }


class Ridge(OLS):
    """Regression whose slope is held back by a quadratic penalty."""

    def __init__(self, penalty: float):
        super().__init__()
        self.penalty = penalty

    def slope(self, s):
        return over(s["sxy"], s["sxx"] + F.lit(self.penalty) * s["w"])

    def fields(self, s, as_of):
        return super().fields(s, as_of) | {"penalty": F.lit(self.penalty)}


class Lasso(Ridge):
    """Regression whose slope is cut by an absolute penalty."""

    def slope(self, s):
        cut = F.greatest(F.abs(s["sxy"]) - F.lit(self.penalty) * s["w"], F.lit(0.0)) * F.signum(s["sxy"])
        return over(cut, s["sxx"])

    def fields(self, s, as_of):
        return super().fields(s, as_of) | {"sxy": s["sxy"]}
