"""Known values, merges against a single pass, independence of partitions, adapters."""

import json
import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rillstats import operators as op
from rillstats.functions import hashing
from rillstats.operators.windows import windowed
from rillstats.plans import run
from rillstats.plans.groups import ListStats, StatGroup, StatSchema, Vectorized, group, stat
from rillstats.plans.stat import discrete, paired, series, vector
from rillstats.sources import load_group, load_state, save_group, save_state

SECOND = 1_000_000_000


def table(spark, rows, names="value double, weight double, ts long, seq long"):
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(float(a), 1.0 if b is None else float(b), c or 0, k if d is None else d) for k, (a, b, c, d) in enumerate(full)], names)


def events(spark, rows, weighted=True):
    df = table(spark, rows)
    return series(df, "value", ts="ts", weight="weight" if weighted else None, seq="seq")


def one(spark, rows, declaration, **more):
    return run.aggregate(events(spark, rows, more.pop("weighted", True)), declaration, **more).first()


def values(*xs):
    return [(x,) for x in xs]


# Fixed vectors


def test_hash_vectors(spark):
    known = {0: 4553024054441242788, 1: 6615013642232309006, -1: -2854182258122887073, 42: 189591720424502296, 2**63 - 1: 2950148240053738312, -(2**63): -6357312718828134429}
    df = spark.createDataFrame([(k,) for k in known], "k long")
    got = {r.k: r.h for r in hashing.with_splitmix64(df, F.col("k"), "h").collect()}
    assert got == known and {k: hashing.splitmix64_int(k) for k in known} == known
    texts = {"": 0, "hello": 6023229995862221380, "the quick brown fox jumps over the lazy dog": 4208025021734807446, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.h for r in df.select("t", hashing.hash64("t").alias("h")).collect()} == texts
    assert hashing.hash64_bytes([bytes(range(16))]).tolist() == [-9112064343569154153]


# Summaries


def test_means_and_variances(spark):
    assert one(spark, values(1e9 + 1, 1e9 + 2, 1e9 + 3), op.Mean()).mean == pytest.approx(1e9 + 2, abs=1e-12)
    assert one(spark, [(10, 1), (100, 0)], op.Mean())[:] == (1.0, 10.0)
    assert one(spark, [(10, 90), (100, 10)], op.Mean()).mean == pytest.approx(19)
    for weighted in (True, False):
        assert one(spark, values(*range(1, 11)), op.Variance(), weighted=weighted).variance == pytest.approx(8.25)
        v = one(spark, values(10, 20), op.Variance(), weighted=weighted)
        assert (v.total_weights, v.mean, v.sst, v.variance, v.std_dev) == pytest.approx((2, 15, 50, 25, 5))
        assert one(spark, values(2, 4, 4, 4, 5, 5, 7, 9), op.Variance(), weighted=weighted).sample_variance == pytest.approx(32 / 7)
    assert one(spark, values(1e9, 1e9 + 1, 1e9 + 2), op.Variance()).variance == pytest.approx(2 / 3, abs=1e-6)


def test_weighted_moments_are_exact(spark):
    m = one(spark, [(1, 2), (2, 1), (5, 3)], op.Moments())
    data, w = [1, 1, 2, 5, 5, 5], 6
    mean = sum(data) / w
    assert [m.m2, m.m3, m.m4] == pytest.approx([sum((x - mean) ** k for x in data) for k in (2, 3, 4)])
    s = one(spark, values(1, 2, 3, 4, 5), op.Moments(), weighted=False)
    assert (s.mean, s.skewness) == pytest.approx((3, 0))
    u = one(spark, values(1, 2, 10, 11, 30), op.Moments(), weighted=False)
    assert u.unbiased_kurtosis == pytest.approx(one(spark, values(1, 2, 10, 11, 30), op.Moments()).unbiased_kurtosis)
    assert one(spark, values(4, 4), op.Moments(), weighted=False)[-4:] == (0.0, 0.0, 0.0, 0.0)


def test_nothing_at_all(spark):
    e = series(table(spark, values(1)).where("false"), "value", ts="ts", weight="weight", seq="seq")
    for s, want in ((op.Sum(), (0.0,)), (op.Count(), (0.0,)), (op.Mean(), (0.0, 0.0)), (op.Min(), (math.inf,)), (op.Max(), (-math.inf,)), (op.Range(), (math.inf, -math.inf))):
        assert tuple(run.aggregate(e, s).first()) == want
    assert all(x == 0 for x in run.aggregate(e, op.Variance()).first()) and all(x == 0 for x in run.aggregate(e, op.Moments()).first())
    assert run.aggregate(paired(e.df, "value", "value"), op.OLS()).first().slope == 0
    for sketch in (op.DDSketch(), op.LinearHistogram(0, 1, 2), op.HdrHistogram()):
        assert sketch.cells(e).count() == 0


def test_extremes_ignore_nan_and_weight(spark):
    rows = [(3, 0), (math.nan, 1), (7, -1)]
    assert one(spark, rows, op.Range())[:] == (3.0, 7.0)
    assert one(spark, rows, op.Count())[0] == 3 and math.isnan(one(spark, rows, op.Sum())[0])


# Decay and rate


def test_decay(spark):
    half = timedelta(seconds=1)
    assert one(spark, [(8, 1, 0)], op.DecayingSum(half), as_of=SECOND).sum == pytest.approx(4, abs=1e-9)
    assert one(spark, [(8, 1, 0), (2, 1, SECOND)], op.DecayingMean(half), as_of=SECOND).mean == pytest.approx(4)
    v = one(spark, [(8, 2, 0), (2, 1, SECOND)], op.DecayingVariance(half), as_of=SECOND)
    assert (v.mean, v.variance) == pytest.approx((5, 9))


def test_rates(spark):
    assert one(spark, [(10, 1, 0)], op.Rate(), as_of=SECOND).rate == pytest.approx(10)
    read = lambda rows, as_of, **more: op.CounterRate(**more).of(events(spark, rows), as_of=as_of).first()
    basic = read([(100, 1, 0), (130, 1, SECOND), (160, 1, 2 * SECOND)], 2 * SECOND)
    assert (basic.total_value, basic.rate) == (60, 30)
    reset = read([(100, 1, 0), (10, 1, SECOND)], 2 * SECOND)
    assert (reset.total_value, reset.start_timestamp_nanos, reset.rate) == (10, SECOND, 10)
    assert read([(100, 1, 0), (10, 1, SECOND)], 2 * SECOND, decrease_is_reset=False).total_value == 0
    mixed = read([(100, 1, SECOND), (120, 1, 0), (130, 1, 2 * SECOND)], 2 * SECOND)
    assert (mixed.total_value, mixed.rate) == (30, 30)


def test_ewma(spark):
    rng = random.Random(2)
    rows = [(rng.random() * 9, rng.random() * 2) for _ in range(40)]
    mean = m2 = total = 0.0
    for v, w in rows:
        a = 1 - math.exp(-0.3 * w)
        mean, m2, total = (1 - a) * mean + a * v, (1 - a) * (m2 + a * (v - mean) ** 2), total + w
    c = 1 - math.exp(-0.3 * total)
    assert op.EwmaMean(0.3).of(events(spark, rows)).first().mean == pytest.approx(mean / c)
    got = op.EwmaVariance(0.3).of(events(spark, rows)).first()
    assert (got.mean, got.variance) == pytest.approx((mean / c, m2 / c))


def slow_ewma(rows, alpha):
    mean = m2 = total = 0.0
    for v, w in rows:
        a = 1 - math.exp(-alpha * w)
        mean, m2, total = (1 - a) * mean + a * v, (1 - a) * (m2 + a * (v - mean) ** 2), total + w
    c = 1 - math.exp(-alpha * total)
    return total, mean / c if c else 0.0, m2 / c if c else 0.0


def test_ewma_far_from_zero_and_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(1e9 + rng.random(), rng.random()) for _ in range(300)]
    e = events(spark, rows)
    want = slow_ewma(rows, 0.2)
    got = op.EwmaVariance(0.2).of(e.with_rows(e.row)).first()
    assert list(got) == pytest.approx(want, rel=1e-5)
    wide = series(e.df.repartition(40), "value", weight="weight", seq="seq")
    assert list(op.EwmaMean(0.2).of(wide).first()) == pytest.approx(want[:2], rel=1e-12)


@pytest.mark.parametrize("size", [7, 40, 10**6])
def test_ranges_give_what_a_whole_key_gives(spark, monkeypatch, size):
    monkeypatch.setattr("rillstats.operators.ordered.RANGE_EVENTS", size)
    rng = random.Random(size)
    rows, now = [], 0
    for _ in range(200):
        now += rng.choice([1, 1, 2, -3, 0]) * SECOND
        rows.append((rng.choice([1, 5, 9, 20, math.nan]), rng.choice([1, 2, 0.5]), now))
    last, total, start = None, 0.0, None
    for v, w, t in rows:
        if math.isnan(v) or (last and t <= last[1]):
            continue
        if last:
            delta = max((v if v < last[0] else v - last[0]) * w, 0)
            if delta > 0 and start is None:
                start = t if v < last[0] else last[1]
            total += delta
        last = (v, t)
    got = op.CounterRate().of(events(spark, rows), as_of=10**12).first()
    assert (got.total_value, got.start_timestamp_nanos) == (pytest.approx(total), start)
    plain = [(v, w) for v, w, _ in rows if not math.isnan(v)]
    assert list(op.EwmaVariance(0.2).of(events(spark, plain)).first()) == pytest.approx(slow_ewma(plain, 0.2))


def test_merges_of_ordered_statistics(spark):
    rng = random.Random(5)
    parts = [[(rng.random() * 9, rng.random() * 2) for _ in range(30)] for _ in range(3)]
    w = m = v = 0.0
    mean_w = mean = 0.0
    for rows in parts:
        rw, rm, rv = slow_ewma(rows, 0.3)
        w1, w2 = 1 - math.exp(-0.3 * w), 1 - math.exp(-0.3 * rw)
        v = (w1 * v + w2 * rv + w1 * w2 * (m - rm) ** 2 / (w1 + w2)) / (w1 + w2)
        m, w = (w1 * m + w2 * rm) / (w1 + w2), w + rw
        w1 = 1 - math.exp(-0.3 * mean_w)
        mean, mean_w = (w1 * mean + w2 * rm) / (w1 + w2), mean_w + rw
    s = op.EwmaVariance(0.3)
    assert list(s.read(s.merge([s.state(events(spark, p)) for p in parts])).first()) == pytest.approx((w, m, v))
    s = op.EwmaMean(0.3)
    assert list(s.read(s.merge([s.state(events(spark, p)) for p in parts])).first()) == pytest.approx((mean_w, mean))
    c = op.CounterRate()
    a, b, nothing = ([(100, 1, SECOND), (130, 1, 2 * SECOND)], [(7, 1, 5 * SECOND), (9, 1, 6 * SECOND)], [(5, 1, 0)])
    got = c.read(c.merge([c.state(events(spark, x), as_of=9 * SECOND) for x in (nothing, b, a)], as_of=9 * SECOND), as_of=9 * SECOND).first()
    assert (got.total_value, got.start_timestamp_nanos, got.rate) == (32, SECOND, 4)
    f = op.FrugalQuantile(0.5, 1.0)
    states = [f.state(events(spark, values(*([x] * n)))) for x, n in ((10, 4), (-10, 2), (10, 6))]
    assert f.read(f.merge(states)).first().quantile == ((2 + -1) / 2 + 3) / 2


def test_frugal_step_by_step(spark):
    rng = random.Random(9)
    rows = [(rng.gauss(50, 10), rng.choice([0, 1, 2, -1])) for _ in range(500)]
    at = 20.0
    for v, w in rows:
        if w > 0:
            at += 0.5 * 0.9 if v > at else -0.5 * (1 - 0.9) if v < at else 0
    got = op.FrugalQuantile(0.9, 0.5, 20.0).of(events(spark, rows)).first()
    assert (got.probability, got.quantile) == (0.9, pytest.approx(at))
    none = events(spark, rows)
    none = series(none.df.where("false"), "value", ts="ts", weight="weight", seq="seq")
    assert op.FrugalQuantile(0.9, 0.5, 20.0).of(none).first().quantile == 20
    assert list(op.EwmaVariance(0.5).of(none).first()) == [0, 0, 0] and list(op.EwmaMean(0.5).of(none).first()) == [0, 0]
    assert op.CounterRate().of(none, as_of=SECOND).first().total_value == 0


# Regression


@pytest.mark.parametrize("weighted", [True, False])
def test_lines(spark, weighted):
    def fit(points, s=None):
        df = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in points], "x double, y double, w double")
        return run.aggregate(paired(df, "x", "y", weight="w" if weighted else None), s or op.OLS()).first()

    for slope, intercept in ((2, 1), (-3, 5), (0, 7)):
        r = fit([(x, slope * x + intercept) for x in range(10)])
        assert (r.slope, r.intercept) == pytest.approx((slope, intercept), abs=1e-6)
    v = fit([(3, y) for y in range(5)])
    assert (v.slope, v.intercept, v.sse) == pytest.approx((0, 2, 10))
    assert fit([(1, 2)]).slope == 0
    r = fit([(0, 0), (1, 2), (2, 4)], op.Ridge(1.0))
    assert r.slope == pytest.approx(4 / (2 + 3))
    assert fit([(0, 0), (1, 2), (2, 4)], op.Lasso(0.5)).slope == pytest.approx((4 - 1.5) / 2)
    assert fit([(0, 1), (1, 3), (2, 5)], op.Covariance()).correlation == pytest.approx(1)


# Merge is a single pass


FLAT = (
    op.Sum(), op.Count(), op.TotalWeights(), op.Mean(), op.Variance(), op.Moments(), op.Min(), op.Max(), op.Range(), op.FixedPointSum(3), op.DecayingSum(timedelta(seconds=3)), op.DecayingMean(timedelta(seconds=3)),
    op.DecayingVariance(timedelta(seconds=3)), op.Rate(),
)


def test_merge_of_flat_statistics(spark):
    rng = random.Random(1)
    df = table(spark, [(rng.gauss(100, 5), rng.randrange(1, 4), rng.randrange(9) * SECOND) for _ in range(200)]).withColumn("k", F.col("seq") % 3)
    named = {f"s{k}": s for k, s in enumerate(FLAT)}
    make = lambda d: series(d, "value", ts="ts", weight="weight")
    parts = [run.states(make(df.where(F.col("seq") % 4 == j)), named, ["k"], as_of=9 * SECOND - j * (j == 0)) for j in range(4)]
    merged = {r.k: r for r in run.read(run.merge(parts, named, ["k"], as_of=9 * SECOND), named, ["k"]).collect()}
    whole = {r.k: r for r in run.aggregate(make(df), named, ["k"], as_of=9 * SECOND).collect()}
    other = {r.k: r for r in run.aggregate(make(df.repartition(16)), named, ["k"], as_of=9 * SECOND).collect()}
    for k, r in whole.items():
        for n in named:
            assert list(merged[k][n]) == pytest.approx(list(r[n]), rel=1e-6, abs=1e-6), n
            assert list(other[k][n]) == pytest.approx(list(r[n]), rel=1e-9, abs=1e-6), n


KEYED = (op.HyperLogLog(8), op.LinearCounting(256), op.BloomFilter(1024, 3), op.CountMinSketch(3, 64), op.MinHash(8))


@pytest.mark.parametrize("sketch", KEYED, ids=lambda s: type(s).__name__)
def test_merge_of_sketches(spark, sketch):
    df = spark.range(500).select((F.col("id") % 97).alias("v"), (F.col("id") % 3).cast("double").alias("w"), "id")
    make = lambda d: discrete(d, "v", weight="w")
    halves = [sketch.cells(make(df.where(F.col("id") % 2 == k))) for k in (0, 1)]
    assert sorted(map(tuple, sketch.merge(halves).collect())) == sorted(map(tuple, sketch.cells(make(df)).collect()))
    with pytest.raises(ValueError):
        sketch.compatible(type(sketch)(*([4] if isinstance(sketch, op.HyperLogLog) else [128])))


def test_accuracy(spark):
    keys = discrete(spark.range(100_000), "id")
    h = op.HyperLogLog(14)
    assert h.read(h.cells(keys)).first().estimate == pytest.approx(100_000, rel=0.03)
    few = discrete(spark.range(100), "id")
    lc = op.LinearCounting(16384)
    assert lc.read(lc.cells(few)).first().estimate == pytest.approx(100, rel=0.05)
    assert op.LinearCounting(64).read(op.LinearCounting(64).cells(keys)).first().estimate == math.inf
    b = op.BloomFilter(4096, 4)
    probes = b.contains(b.cells(discrete(spark.range(1000), "id")), spark.range(3000), "id").collect()
    assert all(r.contained for r in probes if r.id < 1000) and sum(r.contained for r in probes if r.id >= 1000) < 0.32 * 2000
    c = op.CountMinSketch()
    got = c.estimate(c.cells(discrete(spark.range(10_000).select((F.col("id") % 100).alias("v")), "v")), spark.range(100), "id").collect()
    assert all(100 <= r.estimate <= 100 + 20 for r in got)
    m = op.MinHash(256)
    j = m.jaccard(m.cells(discrete(spark.range(0, 900), "id")), m.cells(discrete(spark.range(100, 1000), "id"))).first().jaccard
    assert j == pytest.approx(0.8, abs=0.15)


def test_quantiles(spark):
    for sketch in (op.DDSketch(0.01),):
        e = series(spark.range(-500, 10_001).select(F.col("id").cast("double").alias("v")), "v")
        for r in sketch.read(sketch.cells(e)).collect():
            true = -500 + r.probability * 10_501
            assert r.quantile == pytest.approx(true, rel=0.011)
    t = op.TDigest(100, (0.5, 0.9, 0.99, 0.999))
    e = series(spark.range(1, 10_001).select(F.col("id").cast("double").alias("v")), "v")
    state = t.state(e)
    got = {r.probability: r.quantile for r in t.read(state).collect()}
    assert abs(got[0.5] - 5000) < 150 and abs(got[0.99] - 9900) < 100 and abs(got[0.999] - 9990) < 50
    assert len(state.first().means) <= 600
    s = op.ReservoirHistogram(500, seed=7)
    r = series(spark.range(1, 10_001).select(F.col("id").cast("double").alias("v"), "id"), "v", seq="id")
    sample = s.of(r)
    assert sample.count() == 500 and 4000 <= s.quantile(sample, 0.5).first()[0] <= 6000
    assert sum(b.weight for b in s.histogram(sample, 10).collect()) == 500
    f = op.FrugalQuantile(0.5, step=2.0).of(r).first()
    assert f.quantile > 100


def test_histograms(spark):
    e = events(spark, [(x, 1) for x in (-5, 0, 0.5, 9.99, 10, 11, math.nan)] + [(3, 0)])
    h = op.LinearHistogram(0, 10, 10)
    got = {r.lower_bound: r.weight for r in h.read(h.cells(e)).collect()}
    assert got == {-math.inf: 1, 0: 2, 9: 1, 10: 2}
    again = h.adopted(h.read(h.cells(e)))
    assert {r.idx: r.value for r in again.collect()} == {r.idx: r.value for r in h.cells(e).collect()}
    hdr = op.HdrHistogram(1.0, 3)
    for r in hdr.read(hdr.cells(events(spark, values(0, 1, 2047, 2048, 2049, 5000, 123456789)))).collect():
        assert r.upper_bound - r.lower_bound <= max(1, r.lower_bound / 1000)
    with pytest.raises(Exception, match="not below 0"):
        hdr.cells(events(spark, values(-1))).collect()


def test_values_without_bound(spark):
    d = op.DDSketch(0.01, (0.1, 0.5, 0.95))
    cells = d.cells(events(spark, values(*range(1, 11), math.inf, math.inf, -math.inf, -math.inf, math.nan)))
    assert {r.probability: r.quantile for r in d.read(cells).collect()} == {0.1: -math.inf, 0.5: pytest.approx(5, rel=0.21), 0.95: math.inf}
    assert sum(r.weight for r in d.histogram(cells).collect()) == 15 and (math.inf, math.inf, 2.0) in [tuple(r) for r in d.histogram(cells).collect()]
    h = op.HdrHistogram(1.0, 3)
    got = sorted((r.lower_bound, r.weight) for r in h.read(h.cells(events(spark, values(5, 1e17, 1e300, math.inf)))).collect())
    assert got[0] == (5, 1) and got[1][0] == pytest.approx(1e17, rel=1e-3) and got[2] == (pytest.approx(2.0**63, rel=1e-3), 2)


def test_digests_of_many_values(spark):
    t = op.TDigest(100, (0.5, 0.9))
    wide = series(spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v")), "v")
    assert len(t.state(wide).first().means) <= 600
    small = series(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v")
    assert 47 <= t.of(small).where("probability = 0.5").first().quantile <= 53
    mid = series(spark.range(1, 1001).select(F.col("id").cast("double").alias("v")), "v")
    assert 880 <= t.of(mid).where("probability = 0.9").first().quantile <= 920


def test_hyperloglog_of_few_keys_and_merged(spark):
    h = op.HyperLogLog(14)
    assert h.read(h.cells(discrete(spark.range(1000), "id"))).first().estimate == pytest.approx(1000, rel=0.05)
    p = op.HyperLogLog(12)
    a, b = (discrete(spark.range(k * 10_000, (k + 1) * 10_000), "id") for k in (0, 1))
    whole = p.read(p.cells(discrete(spark.range(20_000), "id"))).first().estimate
    assert p.read(p.merge([p.cells(a), p.cells(b)])).first().estimate == pytest.approx(whole, rel=0.02)


def test_heavy_hitters(spark):
    e = discrete(spark.createDataFrame(list(enumerate([1, 1, 1, 2, 2, 3, 4])), "seq long, v long"), "v", seq="seq")
    s = op.SpaceSaving(3)
    assert {r.key: (r["count"], r.error) for r in s.faithful().of(e).collect()} == {1: (3, 0), 2: (2, 0), 4: (2, 1)}
    f = op.EvictingSpaceSaving(2)
    parts = [f.state(discrete(spark.createDataFrame(list(enumerate(x)), "seq long, v long"), "v", seq="seq")) for x in ([1, 1, 2], [3, 3, 3, 1])]
    assert {r.key: (r["count"], r.error) for r in f.read(f.merge(parts)).collect()} == {1: (3, 0), 3: (4, 1)}
    assert f.faithful().capacity == 2
    assert [(r.key, r["count"]) for r in s.of(e).collect()] == [(1, 3), (2, 2), (3, 1)]


# Adapters


def test_the_last_adapter_runs_first(spark):
    rows = values(1, 2, 3)
    assert one(spark, rows, op.Sum().filter(lambda v: v > 3).transform_value(lambda v: v * 2)).sum == 10
    assert one(spark, rows, op.Sum().transform_value(lambda v: v * 2).filter(lambda v: v > 2)).sum == 6


def test_doubles_as_keys(spark):
    e = events(spark, [(x,) for x in (1.9, -1.9, math.nan, math.inf, -math.inf)])
    got = sorted(r.key for r in op.SpaceSaving(9).as_series().of(e).collect())
    assert got == [-(2**63), -1, 0, 1, 2**63 - 1]


def test_wrong_adapters_raise():
    for bad in (lambda: op.Sum().transform_pair(lambda x, y: (x, y)), lambda: op.OLS().at_x(), lambda: op.Sum().as_series(), lambda: op.DDSketch(1.0), lambda: op.HyperLogLog(3), lambda: op.LinearCounting(100)):
        with pytest.raises((TypeError, ValueError)):
            bad()


def test_dimensions_that_differ(spark):
    df = spark.createDataFrame([("a", [1.0, 1.0, 1.0]), ("a", [2.0, 3.0, 4.0]), ("b", [5.0, 6.0, 7.0])], "k string, v array<double>")
    e = vector(df, "v")
    got = {(r.k, r.dim): r["sum"] for r in run.per_dimension(e, lambda i: op.Sum().with_weight(i + 1), 3, ["k"]).collect()}
    assert got == {("a", 0): 3, ("a", 1): 8, ("a", 2): 15, ("b", 0): 5, ("b", 1): 12, ("b", 2): 21}
    got = {r.dim: r.slope if "slope" in r else r.mean for r in run.per_dimension(e, lambda i: op.Mean().filter(lambda v, i=i: v > i), 3).collect()}
    assert got == {0: pytest.approx(8 / 3), 1: pytest.approx(4.5), 2: pytest.approx(5.5)}
    bins = {(r.dim, r.lower_bound): r.weight for r in run.per_dimension(e, lambda i: op.LinearHistogram(0, 10, (1, 2, 10)[i]), 3).collect()}
    assert bins == {(0, 0): 3, (1, 0): 2, (1, 5): 1, (2, 1): 1, (2, 4): 1, (2, 7): 1}
    assert run.per_dimension(e, lambda i: op.LinearHistogram(0, 10, 2), 3, ["k"]).count() == 6
    with pytest.raises(ValueError):
        run.per_dimension(e, lambda i: op.Sum() if i else op.Mean(), 3)
    mixed = Vectorized(3, lambda i: (op.Sum(), op.Max(), op.SpaceSaving(5).as_series())[i]).aggregate(e).first()
    assert mixed["0"].sum == 8 and mixed["1"].max == 6 and sorted(x.key for x in mixed["2"]) == [1, 4, 7]
    with pytest.raises(Exception, match="3 elements"):
        Vectorized(3, lambda i: op.Sum()).aggregate(vector(spark.createDataFrame([([1.0],)], "v array<double>"), "v")).collect()


def test_vectors_of_another_size_raise(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    with pytest.raises(Exception, match="2 elements"):
        run.per_dimension(vector(df, "v"), lambda i: op.Sum(), 2).collect()


# Windows


@pytest.mark.parametrize(
    ("rows", "as_of", "want"),
    [([(100, 1, 0), (5, 1, 10)], 11, 5), ([(7, 1, 10)], 9, 0), ([(8, 1, 0)], 10, 8), ([(5, 1, 10), (99, 1, 0)], 11, 5)],
)
def test_windows(spark, rows, as_of, want):
    w = windowed(op.Sum(), timedelta(seconds=10), 10)
    e = events(spark, [(v, k, t * SECOND) for v, k, t in rows])
    assert w.read(w.state(e), as_of * SECOND).first().sum == want


def ring(rows, length, slices, duration, as_of):
    places = {}
    for v, t in rows:
        n = int(t / length) if t >= 0 else -int(-t / length)
        at = places.get(n % slices)
        if at is None or at[0] < n:
            places[n % slices] = [n, v]
        elif at[0] == n:
            at[1] += v
    return sum(v for n, v in places.values() if as_of - duration <= n * length <= as_of)


def test_windows_against_a_ring(spark):
    rng = random.Random(8)
    w = windowed(op.Sum(), timedelta(microseconds=1), 7)  # 142 ns a slice
    for _ in range(4):
        rows = [(rng.randrange(1, 9), rng.randrange(-3000, 5000)) for _ in range(60)]
        e = events(spark, [(v, 1, t) for v, t in rows])
        state = w.state(e)
        for as_of in (4999, 2500):
            assert w.read(state, as_of).first().sum == ring(rows, w.length, 7, 1000, as_of)


def test_windows_of_sketches_and_merges(spark):
    w = windowed(op.LinearCounting(1024), timedelta(seconds=10), 10)
    df = spark.range(100).select("id", (F.col("id") * SECOND / 4).cast("long").alias("ts"))
    parts = [w.state(discrete(df.where(F.col("id") % 2 == k), "id", ts="ts")) for k in (0, 1)]
    whole = w.read(w.state(discrete(df, "id", ts="ts")), 24 * SECOND).first()
    assert w.read(w.merge(parts), 24 * SECOND).first() == whole and 30 < whole.estimate < 50


HOUR = 3600 * SECOND


def test_windows_of_values_that_age(spark):
    now = 1_700_000_000 * SECOND
    rows = [(8, 1, now - 5 * HOUR), (4, 2, now - HOUR), (2, 1, now)]
    half = timedelta(hours=1)
    e = events(spark, rows)
    alpha = math.log(2) / HOUR
    left = [w * math.exp(-alpha * (now - t)) for _, w, t in rows]
    sums = sum(v * u for (v, *_), u in zip(rows, left))
    read = lambda s: (lambda w: w.read(w.state(e), now).first())(windowed(s, timedelta(hours=10), 10))
    assert read(op.DecayingSum(half))["sum"] == pytest.approx(sums)
    assert read(op.DecayingMean(half)).mean == pytest.approx(sums / sum(left))
    mean = sums / sum(left)
    assert read(op.DecayingVariance(half)).variance == pytest.approx(sum(u * (v - mean) ** 2 for (v, *_), u in zip(rows, left)) / sum(left))
    assert read(op.DecayingRate(half)).rate == pytest.approx(sums * alpha * 1e9)
    r = read(op.Rate())
    assert (r.total_value, r.start_timestamp_nanos) == (18, now - 5 * HOUR)
    w = windowed(op.DecayingSum(half), timedelta(hours=10), 10)
    parts = [w.state(events(spark, [x])) for x in rows]
    assert w.read(w.merge(parts), now).first()["sum"] == pytest.approx(sums)


def test_windows_of_ordered_statistics(spark):
    rows = [(k % 7, 1, k * SECOND) for k in range(40)]
    e = events(spark, rows)
    by = lambda s, d=20, n=4: windowed(s, timedelta(seconds=d), n)
    got = (lambda w: w.read(w.state(e), 39 * SECOND).first())(by(op.EwmaMean(0.3)))
    slices = {k: [(v, w) for v, w, t in rows if t // (5 * SECOND) == k] for k in (4, 5, 6, 7)}
    w = m = 0.0
    for k in sorted(slices, key=lambda k: k % 4):
        rw, rm, _ = slow_ewma(slices[k], 0.3)
        w1, w2 = 1 - math.exp(-0.3 * w), 1 - math.exp(-0.3 * rw)
        m, w = (w1 * m + w2 * rm) / (w1 + w2), w + rw
    assert list(got) == pytest.approx((w, m))
    live = [v for v, _, t in rows if t >= 20 * SECOND]
    t = (lambda w: w.read(w.state(e), 39 * SECOND).collect())(by(op.TDigest(100, (0.5,))))
    assert min(live) <= t[0].quantile <= max(live)
    hits = (lambda w: w.read(w.state(e), 39 * SECOND).collect())(by(op.SpaceSaving(3).as_series()))
    assert {r.key: r["count"] for r in hits} == {0: 3, 1: 3, 2: 3}
    sample = (lambda w: w.read(w.state(e), 39 * SECOND).collect())(by(op.ReservoirHistogram(5)))
    assert len(sample) == 5 and {r.value for r in sample} <= set(live)


def test_windows_of_groups(spark):
    rows = [(k, 1, k * SECOND) for k in range(40)]
    g = StatGroup(stat("sum", op.Sum()), stat("rate", op.DecayingSum(timedelta(seconds=5))), stat("bins", op.LinearHistogram(0, 40, 4)), stat("hits", op.SpaceSaving(2).as_series().filter(lambda v: v < 30)))
    w = windowed(g, timedelta(seconds=20), 4)
    e = events(spark, rows)
    r = w.read(w.state(e), 39 * SECOND).first()
    assert r["sum"].sum == sum(range(20, 40)) and sorted((b.lower_bound, b.weight) for b in r.bins) == [(20, 10), (30, 10)]
    assert [h.key for h in r.hits] == [20, 21]
    assert r.rate.sum == pytest.approx(sum(v * 2.0 ** (-(39 - v) / 5) for v in range(20, 40)))
    parts = [w.state(events(spark, [x for x in rows if x[0] % 2 == k])) for k in (0, 1)]
    assert w.read(w.merge(parts), 39 * SECOND).first()["sum"] == r["sum"]
    # an event that a member leaves out still makes its slice
    f = windowed(op.LinearCounting(64).as_series().filter(lambda v: v < 5), timedelta(seconds=4), 4)
    assert f.read(f.state(events(spark, [(1, 1, 0), (99, 1, 4 * SECOND)])), 4 * SECOND).collect() in ([], [(0.0, 64, 64)])


# Groups


class Requests(StatSchema):
    requests = op.Count()

    class size(StatSchema):
        total = op.Sum()


def test_groups(spark):
    g = StatGroup(stat("sum", op.Sum()), stat("count", op.Count()))
    r = g.aggregate(events(spark, [(2, 3), (4, 0.5)])).first()
    assert (r["sum"].sum, r["count"].sum) == (8, 2)
    s = Requests.group()
    a, b = s.states(events(spark, values(120, 80))), s.states(events(spark, values(50, 30)))
    r = s.read(s.merge([a, b])).first()
    assert (r.requests.sum, r.size.total.sum) == (4, 280)
    nested = StatGroup(stat("sum", op.Sum()), group("more", stat("count", op.Count()), stat("bins", op.LinearHistogram(0, 10, 2))))
    r = nested.aggregate(events(spark, values(1, 6, 7))).first()
    assert r["sum"].sum == 14 and r.more["count"].sum == 3 and sorted(b.weight for b in r.more.bins) == [1, 2]
    rows = ListStats(op.Sum(), op.Max()).rows(events(spark, values(1, 2))).collect()
    assert [(x.pos, x.name, x.result) for x in rows] == [(0, "Sum", '{"sum":3.0}'), (1, "Max", '{"max":2.0}')]
    rows = nested.rows(events(spark, values(1, 6, 7))).collect()
    assert [(x.pos, x.name) for x in rows] == [(0, "sum"), (1, "more")] and json.loads(rows[1].result)["count"] == {"sum": 3.0}
    with pytest.raises(ValueError):
        StatGroup(stat("a", op.Sum()), stat("a", op.Count()))
    with pytest.raises(ValueError):
        StatGroup(stat("a", op.Sum()), stat("b", op.OLS()))


def test_groups_of_all_kinds_have_states(spark):
    g = StatGroup(
        stat("sum", op.Sum()), stat("bins", op.LinearHistogram(0, 100, 2)), stat("keys", op.HyperLogLog(8).as_series()), stat("ewma", op.EwmaMean(0.1)), stat("top", op.SpaceSaving(2).as_series()),
        group("in", stat("digest", op.TDigest(100, (0.5,))), stat("counter", op.CounterRate()), stat("sample", op.ReservoirHistogram(3)), stat("frugal", op.FrugalQuantile(0.5, 1.0))),
    )
    rows = [(float(k), 1, k * SECOND, k) for k in range(100)]
    whole = g.aggregate(events(spark, rows), as_of=99 * SECOND).first()
    halves = [g.states(events(spark, rows[:50]), as_of=99 * SECOND), g.states(events(spark, rows[50:]), as_of=99 * SECOND)]
    got = g.read(g.merge(halves, as_of=99 * SECOND), as_of=99 * SECOND).first()
    assert got["sum"] == whole["sum"] and sorted(got.bins) == sorted(whole.bins) and got["keys"] == whole["keys"] and [t["count"] for t in got.top] == [1, 1]
    assert got["in"].digest[0].quantile == pytest.approx(whole["in"].digest[0].quantile, abs=5) and sorted(got["in"].sample) == sorted(whole["in"].sample)
    assert (whole["in"].counter.total_value, got["in"].counter.total_value) == (99, 98) and whole["in"].frugal.quantile == pytest.approx(46, abs=10)
    by = g.aggregate(series(table(spark, rows).withColumn("k", F.when(F.col("seq") % 3 > 0, F.col("seq") % 3)), "value", ts="ts", seq="seq"), ["k"], as_of=99 * SECOND).collect()
    assert {r.k for r in by} == {None, 1, 2} and sum(r["sum"].sum for r in by) == whole["sum"].sum and all(len(r.bins) == 2 for r in by)
    only = StatGroup(stat("bins", op.LinearHistogram(0, 100, 2)))
    assert len(only.read(only.merge([only.states(events(spark, rows))])).first().bins) == 2


def test_stored_states_of_groups(spark, tmp_path):
    g = StatGroup(stat("sum", op.Sum()), group("in", stat("bins", op.LinearHistogram(0, 10, 2)), stat("ewma", op.EwmaMean(0.1))))
    state = g.states(events(spark, values(1, 2, 7)))
    save_group(state, g, str(tmp_path / "g"))
    assert g.read(load_group(spark, g, str(tmp_path / "g"))).first() == g.read(state).first()
    with pytest.raises(ValueError):
        load_group(spark, StatGroup(stat("sum", op.Sum()), group("in", stat("bins", op.LinearHistogram(0, 10, 5)), stat("ewma", op.EwmaMean(0.1)))), str(tmp_path / "g"))


def test_own_hashes(spark):
    import zlib

    df = spark.createDataFrame([("a",), ("bc",), (None,)], "t string")
    own = hashing.hash_by(lambda xs: [zlib.crc32(x) for x in xs])
    assert [r.h for r in df.select(own("t").alias("h")).collect()] == [zlib.crc32(b"a"), zlib.crc32(b"bc"), None]


def test_adapters_of_groups(spark):
    g = StatGroup(stat("sum", op.Sum()), group("in", stat("n", op.Count()), stat("bins", op.LinearHistogram(0, 10, 1))))
    r = g.filter(lambda v: v > 1).transform_value(lambda v: v * 2).aggregate(events(spark, values(0, 1, 2))).first()
    assert (r["sum"].sum, r["in"].n.sum, r["in"].bins[0].weight) == (6, 2, 2)
    p = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "x double, y double")
    assert g.at_y().aggregate(paired(p, "x", "y")).first()["sum"].sum == 30
    mapped = g.map_result(lambda m: {"twice": m["sum"]["sum"] * 2, **m}).aggregate(events(spark, values(4))).first()
    assert mapped.twice == 8 and mapped["sum"].sum == 4
    assert op.SpaceSaving(2).as_series().map_result(lambda m: {"key": m["key"] * 10}).kind == "ordered"
    assert [r.ten for r in run.results(events(spark, values(3)), op.SpaceSaving(2).as_series().map_result(lambda m: {"ten": m["key"] * 10})).collect()] == [30]
    two = ListStats(op.Sum(), op.Max())
    with pytest.raises(ValueError):
        two.merge([two.states(events(spark, values(1))), ListStats(op.Sum()).states(events(spark, values(1)))])
    for own, e in ((ListStats(op.OLS(), op.Covariance()), paired(p, "x", "y")), (ListStats(op.Sum().at_index(0)), vector(p.select(F.array("x", "y").alias("v")), "v")), (ListStats(op.LinearCounting(64), op.HyperLogLog(4)), discrete(p.selectExpr("int(x) k"), "k"))):
        s = own.states(e)
        assert len(own.read(own.merge([s, s])).first()) == len(own.members)


def test_a_part_without_a_member(spark):
    small, large = StatGroup(stat("a", op.Sum())), StatGroup(stat("a", op.Sum()), stat("b", op.Count()))
    parts = [small.states(events(spark, values(1))), large.states(events(spark, values(2, 3)))]
    r = large.read(large.merge(parts)).first()
    assert (r.a.sum, r.b.sum) == (6, 2)


def test_stored_states(spark, tmp_path):
    h = op.HyperLogLog(8)
    cells = h.cells(discrete(spark.range(1000), "id"))
    save_state(cells, h, str(tmp_path / "s"))
    assert h.read(load_state(spark, h, str(tmp_path / "s"))).first() == h.read(cells).first()
    with pytest.raises(ValueError):
        load_state(spark, op.HyperLogLog(9), str(tmp_path / "s"))
