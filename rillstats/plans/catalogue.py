"""The registered queries: one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..functions.hashing import MULTIPLIER_1, MULTIPLIER_2, hash64, splitmix64_int, with_splitmix64
from ..operators.flat import per
from ..operators.windows import windowed
from ..sources.tables import read_table
from . import run
from .groups import ListStats, StatGroup, StatSchema, Vectorized, group, stat
from .stat import discrete, nanos, paired, series, vector

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, so that the order of addition doesn't show."""
    return df.select(*((F.round(c, other.get(c, digits)) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _li(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem")


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").withColumn("ts_nanos", nanos(F.col("ts")))


def _prices(spark, d, weight: str | None = "l_quantity"):
    return series(_li(spark, d), "l_extendedprice", weight=weight)


def _values(spark, d, **more):
    return series(_ev(spark, d), "value", ts="ts_nanos", seq="event_id", **more)


def _pairs(spark, d, weight=None):
    return paired(_li(spark, d), "l_quantity", "l_extendedprice", weight=weight)


def _vectors(spark, d, **more):
    return vector(read_table(spark, d, "embeddings"), "embedding", **more)


def _parts(spark, d, **more):
    return discrete(_li(spark, d), "l_partkey", **more)


_NANOS = "epoch_us(ts) * 1000"
_FLAG, _TYPE = ["l_returnflag"], ["event_type"]

# Summaries

query("sum_weighted", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity), 2) AS sum FROM lineitem GROUP BY 1")(
    lambda s, d: rounded(run.aggregate(_prices(s, d), op.Sum(), _FLAG), 2)
)
query("count_events", "SELECT event_type, count(*)::DOUBLE AS sum FROM events WHERE value IS NOT NULL GROUP BY 1")(
    lambda s, d: run.aggregate(_values(s, d), op.Count(), _TYPE)
)
query("total_weights", "SELECT l_returnflag, sum(l_quantity)::DOUBLE AS sum FROM lineitem GROUP BY 1")(
    lambda s, d: run.aggregate(_prices(s, d), op.TotalWeights(), _FLAG)
)
query("mean_weighted", """
SELECT l_returnflag, sum(l_quantity)::DOUBLE AS total_weights, round(sum(l_extendedprice * l_quantity) /
sum(l_quantity), 5) AS mean FROM lineitem
GROUP BY 1""")(
    lambda s, d: rounded(run.aggregate(_prices(s, d), op.Mean(), _FLAG), 5)
)
query("mean_unit", """
SELECT event_type, count(value)::DOUBLE AS total_weights, round(avg(value), 6) AS mean
FROM events GROUP BY 1""")(lambda s, d: rounded(run.aggregate(_values(s, d), op.Mean(), _TYPE)))
query(
    "variance_unit",
    """
SELECT event_type, count(value)::DOUBLE AS total_weights, round(avg(value), 5) AS mean, round(var_pop(value), 4)
AS variance, round(stddev_pop(value), 5) AS std_dev, round(var_samp(value), 4) AS sample_variance,
round(stddev_samp(value), 5) AS sample_std_dev
FROM events GROUP BY 1""",
)(lambda s, d: rounded(run.aggregate(_values(s, d), op.Variance(), _TYPE).drop("sst"), 5, variance=4, sample_variance=4))
_WEIGHTED = """
(SELECT l_returnflag, l_extendedprice AS v, l_quantity AS w, sum(l_extendedprice * l_quantity) OVER g /
sum(l_quantity) OVER g AS m FROM lineitem
WINDOW g AS (PARTITION BY l_returnflag))"""
query(
    "variance_weighted",
    f"""
SELECT l_returnflag, sum(w)::DOUBLE AS total_weights, round(max(m), 4) AS mean, round(sum(w * (v - m) ** 2) /
sum(w), 1) AS variance, round(sqrt(sum(w * (v - m) ** 2) / sum(w)), 4) AS std_dev
FROM {_WEIGHTED} GROUP BY 1""",
)(lambda s, d: rounded(run.aggregate(_prices(s, d), op.Variance(), _FLAG).select("l_returnflag", "total_weights", "mean", "variance", "std_dev"), 4, variance=1))
query(
    "moments_unit",
    """
SELECT event_type, n AS total_weights, round(m, 5) AS mean, round(m2 / n, 4) AS variance, round(m3 / n / (m2 /
n) ** 1.5, 6) AS skewness, round(m4 / n / (m2 / n) ** 2 - 3, 6) AS kurtosis
FROM (SELECT event_type, count(*)::DOUBLE AS n, max(m) AS m, sum((value - m) ** 2) AS m2, sum((value - m) ** 3)
AS m3, sum((value - m) ** 4) AS m4
FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m
FROM events WHERE value IS NOT NULL)
GROUP BY 1)""",
)(lambda s, d: rounded(run.aggregate(_values(s, d), op.Moments(), _TYPE).select("event_type", "total_weights", "mean", "variance", "skewness", "kurtosis"), 6, mean=5, variance=4))
query(
    "moments_weighted",
    f"""
SELECT l_returnflag, round(max(m), 4) AS mean, round((sum(w * (v - m) ** 3) / sum(w)) / (sum(w * (v - m) ** 2) /
sum(w)) ** 1.5, 6) AS skewness, round((sum(w * (v - m) ** 4) / sum(w)) / (sum(w * (v - m) ** 2) / sum(w)) ** 2 -
3, 6) AS kurtosis FROM {_WEIGHTED}
GROUP BY 1""",
)(lambda s, d: rounded(run.aggregate(_prices(s, d), op.Moments(), _FLAG).select("l_returnflag", "mean", "skewness", "kurtosis"), 6, mean=4))
query("min_value", "SELECT event_type, min(value) AS min FROM events GROUP BY 1")(
    lambda s, d: run.aggregate(_values(s, d), op.Min(), _TYPE)
)
query("max_value", "SELECT event_type, max(value) AS max FROM events GROUP BY 1")(
    lambda s, d: run.aggregate(_values(s, d), op.Max(), _TYPE)
)
query("range_values", "SELECT event_type, min(value) AS min, max(value) AS max FROM events GROUP BY 1")(
    lambda s, d: run.aggregate(_values(s, d), op.Range(), _TYPE)
)
query("fixed_point_sum", """
SELECT l_returnflag, sum(trunc(l_extendedprice * 1e6)::HUGEINT)::DOUBLE / 1e6 AS sum
FROM lineitem GROUP BY 1""")(
    lambda s, d: run.aggregate(_prices(s, d, None), op.FixedPointSum(6), _FLAG)
)


@query("rollup_summary", """
SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n, round(sum(l_extendedprice * l_quantity), 1) AS total,
round(avg(l_extendedprice), 5) AS mean
FROM lineitem GROUP BY ROLLUP (1, 2)""")
def rollup_summary(s, d):
    e = _prices(s, d)
    r, plain = e.row, type(e.row)(value=e.row.value)
    parts = {"n": op.Count().partials(r, {}, None)["sum"], "total": op.Sum().partials(r, {}, None)["sum"], "mean": op.Mean().partials(plain, {}, None)["mean"]}
    got = e.df.rollup("l_returnflag", "l_linestatus").agg(*(c.alias(n) for n, c in parts.items()))
    return rounded(got, 5, total=1)


# Decay and rate

_DAY = timedelta(days=1)
_ALPHA = op.DecayingSum(_DAY).alpha
_DECAYED = f"""
(SELECT event_type, value, exp(-{_ALPHA!r}::DOUBLE * (max({_NANOS}) OVER () - {_NANOS})::DOUBLE) AS u,
max({_NANOS}) OVER () AS t, {_NANOS} AS ts
FROM events WHERE value IS NOT NULL)"""
query("decaying_sum", f"""
SELECT event_type, round(sum(value * u), 5) AS sum, max(t)::BIGINT AS timestamp_nanos
FROM {_DECAYED} GROUP BY 1""")(lambda s, d: rounded(run.aggregate(_values(s, d), op.DecayingSum(_DAY), _TYPE), 5))
query("decaying_mean", f"""
SELECT event_type, round(sum(value * u) / sum(u), 6) AS mean, round(sum(u), 6) AS total_weights, max(t)::BIGINT
AS timestamp_nanos FROM {_DECAYED}
GROUP BY 1""")(
    lambda s, d: rounded(run.aggregate(_values(s, d), op.DecayingMean(_DAY), _TYPE))
)
query(
    "decaying_variance",
    f"""
SELECT event_type, round(max(m), 5) AS mean, round(sum(u * (value - m) ** 2) / sum(u), 4) AS variance,
round(sqrt(sum(u * (value - m) ** 2) / sum(u)), 5) AS std_dev, round(sum(u), 5) AS total_weights, max(t)::BIGINT
AS timestamp_nanos FROM (SELECT *, sum(value * u) OVER g / sum(u) OVER g AS m
FROM {_DECAYED} WINDOW g AS (PARTITION BY event_type))
GROUP BY 1""",
)(lambda s, d: rounded(run.aggregate(_values(s, d), op.DecayingVariance(_DAY), _TYPE), 5, variance=4))
query("decaying_rate", f"""
SELECT event_type, round(sum(value * u) * {_ALPHA * 1e9!r}::DOUBLE, 6) AS rate, max(t)::BIGINT AS
timestamp_nanos FROM {_DECAYED}
GROUP BY 1""")(
    lambda s, d: rounded(run.aggregate(_values(s, d), op.DecayingRate(_DAY), _TYPE))
)
query(
    "rate_total",
    f"""
SELECT event_type, start AS start_timestamp_nanos, round(total, 5) AS total_value, t AS timestamp_nanos, CASE
WHEN t > start THEN round(total / ((t - start) / 1e9::DOUBLE), 6) ELSE 0.0::DOUBLE END AS rate
FROM (SELECT event_type, arg_min(ts, event_id) AS start, sum(value) AS total, max(t) AS t
FROM (SELECT event_type, event_id, value, {_NANOS} AS ts, max({_NANOS}) OVER () AS t
FROM events WHERE value IS NOT NULL)
GROUP BY 1)""",
)(lambda s, d: rounded(run.aggregate(_values(s, d), op.Rate(), _TYPE), 6, total_value=5))
query(
    "rate_per_hour",
    f"""
SELECT event_type, round(total / ((t - start) / 1e9::DOUBLE) * 3600, 4) AS per_hour
FROM (SELECT event_type, arg_min(ts, event_id) AS start, sum(value) AS total, max(t) AS t
FROM (SELECT event_type, event_id, value, {_NANOS} AS ts, max({_NANOS}) OVER () AS t
FROM events WHERE value IS NOT NULL)
GROUP BY 1)""",
)(lambda s, d: rounded(run.aggregate(_values(s, d), op.Rate(), _TYPE).select("event_type", per(F.col("rate"), timedelta(hours=1)).alias("per_hour")), 4))


@query(
    "counter_rate",
    f"""WITH e AS (SELECT user_id, event_id, {_NANOS} AS ts, value AS v, max({_NANOS}) OVER () AS t FROM events WHERE value IS NOT NULL),
k AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM e) WHERE late IS NULL OR ts > late),
b AS (SELECT *, lag(v) OVER w AS before, lag(ts) OVER w AS since FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, coalesce(greatest(CASE WHEN v < before THEN v ELSE v - before END, 0), 0) AS delta FROM b),
r AS (SELECT user_id, sum(delta) AS total, coalesce(arg_min(CASE WHEN delta > 0 THEN CASE WHEN v < before THEN ts ELSE since END END, CASE WHEN delta > 0 THEN event_id END), max(t)) AS start, max(t) AS t FROM g GROUP BY 1)
SELECT user_id, round(total, 5) AS total_value, start AS start_timestamp_nanos, t AS timestamp_nanos, CASE WHEN t > start THEN round(total / ((t - start) / 1e9::DOUBLE), 6) ELSE 0.0::DOUBLE END AS rate FROM r""",
)
def counter_rate(s, d):
    return rounded(op.CounterRate().of(_values(s, d), ["user_id"]), 6, total_value=5)


query(
    "ewma_mean",
    """
SELECT event_type, count(*)::DOUBLE AS total_weights, round(sum((1 - exp(-0.05::DOUBLE)) * value *
exp(-0.05::DOUBLE * later)) / (1 - exp(-0.05::DOUBLE * count(*))), 6) AS mean
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type
ORDER BY event_id DESC) - 1 AS later
FROM events WHERE value IS NOT NULL)
GROUP BY 1""",
)(lambda s, d: rounded(op.EwmaMean(0.05).of(_values(s, d), _TYPE)))
query(
    "ewma_variance",
    """
WITH e AS (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS later
  FROM events WHERE value IS NOT NULL),
s AS (
  SELECT event_type, count(*)::DOUBLE AS w, sum((1 - exp(-0.05::DOUBLE)) * value * exp(-0.05::DOUBLE * later)) AS m,
         sum((1 - exp(-0.05::DOUBLE)) * value * value * exp(-0.05::DOUBLE * later)) AS q
  FROM e GROUP BY 1)
SELECT event_type, w AS total_weights, round(m / (1 - exp(-0.05::DOUBLE * w)), 6) AS mean,
       round((q - m * m) / (1 - exp(-0.05::DOUBLE * w)), 6) AS variance
FROM s""",
)(lambda s, d: rounded(op.EwmaVariance(0.05).of(_values(s, d), _TYPE)))
_DOWN = repr(1.0 * (1 - 0.9))
query(
    "frugal_quantile",
    f"""
WITH l AS (
  SELECT event_type, list_prepend(0.0::DOUBLE, list(value ORDER BY event_id)) AS vs
  FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, 0.9::DOUBLE AS probability,
       round(list_reduce(vs, lambda a, v: CASE WHEN v > a THEN a + 0.9::DOUBLE WHEN v < a THEN a - {_DOWN}::DOUBLE ELSE a END), 6) AS quantile
FROM l""",
)(lambda s, d: rounded(op.FrugalQuantile(0.9, step=1.0).of(_values(s, d), _TYPE)))

# Regression

_REGR = """
FROM (SELECT l_returnflag, count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy,
regr_syy(l_extendedprice, l_quantity) AS syy
FROM lineitem GROUP BY 1)"""
query(
    "ols",
    f"""
SELECT l_returnflag, n AS total_weights, round(sxy / sxx, 5) AS slope, round(my - sxy / sxx * mx, 3) AS
intercept, round(sqrt((syy - sxy * sxy / sxx) / n), 3) AS rmse, round(sxy * sxy / sxx / syy, 6) AS r_squared,
round(sxy / sqrt(sxx * syy), 6) AS correlation {_REGR}""",
)(lambda s, d: rounded(run.aggregate(_pairs(s, d), op.OLS(), _FLAG).select("l_returnflag", "total_weights", "slope", "intercept", "rmse", "r_squared", "correlation"), 6, slope=5, intercept=3, rmse=3))
query(
    "ols_weighted",
    """
SELECT l_returnflag, sum(w)::DOUBLE AS total_weights, round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) **
2), 4) AS slope FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, l_linenumber::DOUBLE AS w,
sum(l_quantity * l_linenumber) OVER g / sum(l_linenumber) OVER g AS mx, sum(l_extendedprice * l_linenumber) OVER
g / sum(l_linenumber) OVER g AS my
FROM lineitem WINDOW g AS (PARTITION BY l_returnflag))
GROUP BY 1""",
)(lambda s, d: rounded(run.aggregate(_pairs(s, d, F.col("l_linenumber").cast("double")), op.OLS(), _FLAG).select("l_returnflag", "total_weights", "slope"), 4))
query(
    "covariance",
    f"""
SELECT l_returnflag, n AS total_weights, round(mx, 6) AS mean_x, round(my, 4) AS mean_y, round(sxy / n, 3) AS
covariance, round(sxy / sqrt(sxx * syy), 6) AS correlation, round(sxx / n, 5) AS var_x, round(syy / n, 1) AS
var_y {_REGR}""",
)(lambda s, d: rounded(run.aggregate(_pairs(s, d), op.Covariance(), _FLAG).drop("sxy", "sxx", "syy"), 6, mean_y=4, covariance=3, var_x=5, var_y=1))
query("ridge", f"""
SELECT l_returnflag, round(sxy / (sxx + 2.5 * n), 5) AS slope, round(my - sxy / (sxx + 2.5 * n) * mx, 3) AS
intercept {_REGR}""")(
    lambda s, d: rounded(run.aggregate(_pairs(s, d), op.Ridge(2.5), _FLAG).select("l_returnflag", "slope", "intercept"), 5, intercept=3)
)
query("lasso", f"""
SELECT l_returnflag, round(sign(sxy) * greatest(abs(sxy) - 50000.0 * n, 0) / sxx, 5) + 0.0 AS slope {_REGR}""")(
    lambda s, d: rounded(run.aggregate(_pairs(s, d), op.Lasso(50000.0), _FLAG).select("l_returnflag", "slope"), 5)
)

# Quantiles and histograms

_GAMMA = op.DDSketch().gamma
_DD = f"""
(SELECT sign(c_acctbal)::INT AS sign, CASE WHEN c_acctbal <> 0 THEN ceil(ln(abs(c_acctbal)) /
ln({_GAMMA!r}::DOUBLE)) ELSE 0 END::INT AS idx, count(*)::DOUBLE AS value
FROM customer GROUP BY 1, 2)"""


def _balances(s, d):
    return series(read_table(s, d, "customer"), "c_acctbal")


query("ddsketch_cells", f"SELECT * FROM {_DD}")(lambda s, d: op.DDSketch().cells(_balances(s, d)))
query(
    "ddsketch_quantiles",
    f"""
WITH b AS (SELECT sign * 2 * {_GAMMA!r}::DOUBLE ** idx / (1 + {_GAMMA!r}::DOUBLE) AS v, sum(value) OVER (ORDER
BY sign, sign * idx) AS cum, sum(value) OVER () AS total
FROM {_DD}) SELECT p::DOUBLE AS probability, round(min(v), 5) AS quantile, max(total) AS total_weights
FROM b, (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99, 0.999]) AS p)
WHERE cum >= p::DOUBLE * total GROUP BY 1""",
)(lambda s, d: rounded((lambda q: q.read(q.cells(_balances(s, d))))(op.DDSketch()), 5, probability=6))
query(
    "sketch_to_histogram",
    f"""
SELECT round(CASE WHEN sign > 0 THEN {_GAMMA!r}::DOUBLE ** (idx - 1) WHEN sign < 0 THEN -({_GAMMA!r}::DOUBLE **
idx) ELSE 0 END, 5) AS lower_bound, round(CASE WHEN sign > 0 THEN {_GAMMA!r}::DOUBLE ** idx WHEN sign < 0 THEN
-({_GAMMA!r}::DOUBLE ** (idx - 1)) ELSE 0 END, 5) AS upper_bound, value AS weight
FROM {_DD}""",
)(lambda s, d: rounded((lambda q: q.histogram(q.cells(_balances(s, d))))(op.DDSketch()), 5))
query(
    "linear_histogram",
    """
SELECT CASE WHEN k < 0 THEN '-inf'::DOUBLE ELSE -500 + k * 250.0 END::DOUBLE AS lower_bound, CASE WHEN k >= 40
THEN 'inf'::DOUBLE ELSE -500 + (k + 1) * 250.0 END::DOUBLE AS upper_bound, count(*)::DOUBLE AS weight
FROM (SELECT CASE WHEN c_acctbal < -500 THEN -1 WHEN c_acctbal >= 9500 THEN 40 ELSE floor((c_acctbal + 500) /
250) END AS k FROM customer) GROUP BY k""",
)(lambda s, d: (lambda q: q.read(q.cells(_balances(s, d))))(op.LinearHistogram(-500, 9500, 40)))
query(
    "hdr_histogram",
    """
SELECT first * 2 ** sh * 0.01 AS lower_bound, (first + 1) * 2 ** sh * 0.01 AS upper_bound, count(*)::DOUBLE AS
weight FROM (SELECT sh, (u >> sh)::DOUBLE AS first
FROM (SELECT u, greatest(length(bin(greatest(u, 1))) - 11, 0)::INT AS sh
FROM (SELECT trunc(o_totalprice * (1 / 0.01::DOUBLE))::BIGINT AS u
FROM orders))) GROUP BY 1, 2""".replace("first * 2 ** sh * 0.01", "round(first * 2 ** sh * 0.01::DOUBLE, 4)").replace("(first + 1) * 2 ** sh * 0.01 AS", "round((first + 1) * 2 ** sh * 0.01::DOUBLE, 4) AS").replace("GROUP BY 1, 2", "GROUP BY first, sh"),
)(lambda s, d: rounded((lambda q: q.read(q.cells(series(read_table(s, d, "orders"), "o_totalprice"))))(op.HdrHistogram(0.01, 3)), 4))


@query("tdigest_bounds", "SELECT unnest([0.01, 0.1, 0.5, 0.9, 0.99])::DOUBLE AS probability, true AS within")
def tdigest_bounds(s, d):
    """Whether each quantile's share of smaller values is as near to its probability as the scale promises."""
    prices = series(read_table(s, d, "orders"), "o_totalprice")
    t = op.TDigest(probabilities=(0.01, 0.1, 0.5, 0.9, 0.99))
    got = t.of(prices)
    below = prices.df.crossJoin(F.broadcast(got)).groupBy("probability").agg(F.avg((prices.row.value <= F.col("quantile")).cast("double")).alias("share"))
    p = F.col("probability")
    return below.select(p, (F.abs(F.col("share") - p) <= 4 * F.sqrt(p * (1 - p)) / 100 + 0.005).alias("within"))


query("tdigest_weights", "SELECT o_orderstatus, count(*)::DOUBLE AS weight FROM orders GROUP BY 1")(
    lambda s, d: (lambda q: q.histogram(q.state(series(read_table(s, d, "orders"), "o_totalprice"), ["o_orderstatus"]), ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.sum("weight").alias("weight")))(op.TDigest())
)
query("tdigest_quantiles")(lambda s, d: (lambda q: q.read(q.state(series(read_table(s, d, "orders"), "o_totalprice"))))(op.TDigest()))
query("tdigest_histogram")(
    lambda s, d: (lambda q: q.histogram(q.state(series(read_table(s, d, "orders"), "o_totalprice"), ["o_orderstatus"]), ["o_orderstatus"]))(op.TDigest())
)


def _sample(s, d):
    return op.ReservoirHistogram(512, seed=7).of(series(read_table(s, d, "orders"), "o_totalprice", seq="o_orderkey"))


# Keys: hashes in SQL with 128-bit numbers

_M = "18446744073709551615::UHUGEINT"


def _u(x: int) -> str:
    return f"{x & 0xFFFFFFFFFFFFFFFF}::UHUGEINT"


def _mix_sql(source: str, value: str, name: str) -> str:
    """A subquery with the hash of an unsigned value."""
    q = f"(SELECT *, ({value} + {_u(-7046029254386353133)}) & {_M} AS {name}_0 FROM {source})"
    q = f"(SELECT *, (xor({name}_0, {name}_0 >> 30) * {_u(MULTIPLIER_1)}) & {_M} AS {name}_1 FROM {q})"
    q = f"(SELECT *, (xor({name}_1, {name}_1 >> 27) * {_u(MULTIPLIER_2)}) & {_M} AS {name}_2 FROM {q})"
    return f"(SELECT *, xor({name}_2, {name}_2 >> 31) AS {name} FROM {q})"


def _signed_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN ({x}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {x}::BIGINT END"


_KEYS = "(SELECT DISTINCT l_partkey AS k FROM lineitem)"
_HASHED = _mix_sql(_KEYS, "k::UHUGEINT", "h")
query("splitmix64_keys", f"SELECT k, {_signed_sql('h')} AS h FROM {_HASHED}")(
    lambda s, d: with_splitmix64(_li(s, d).select(F.col("l_partkey").alias("k")).distinct(), F.col("k"), "h")
)

def _words_sql() -> str:
    """doc_id, the text's length in bytes and its 8-byte parts, little-endian, as numbers."""
    pairs = " || ".join(f"substr(x, {k}, 2)" for k in range(15, 0, -2))
    return f"""(
  SELECT doc_id, n, list_transform(range(0, (n + 7) // 8), lambda k: rpad(substr(hx, 16 * k + 1, 16), 16, '0')) AS parts
  FROM (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS hx FROM documents WHERE text IS NOT NULL))""", pairs


_PARTS, _PAIRS = _words_sql()
_STEP = _mix_sql("(SELECT r.doc_id, r.k + 1 AS k, xor(r.h, p.word) AS x FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k)", "x", "h")
query(
    "hash64_strings",
    f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, n, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS k FROM {_PARTS}),
p AS MATERIALIZED (SELECT doc_id, k, ('0x' || {_PAIRS})::UBIGINT::UHUGEINT AS word FROM w),
r(doc_id, k, h) AS (
  SELECT doc_id, 0::BIGINT, octet_length(encode(text))::UHUGEINT FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, k, h FROM {_STEP})
SELECT doc_id, {_signed_sql('h')} AS h FROM (SELECT doc_id, arg_max(h, k) AS h FROM r GROUP BY 1)
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
)(lambda s, d: read_table(s, d, "documents").select("doc_id", hash64("text").alias("h")))
_SEED = splitmix64_int(7)
_KEYED = _mix_sql(f"(SELECT o_totalprice AS value, xor(o_orderkey::UHUGEINT, {_u(_SEED)}) AS x FROM orders)", "x", "h")
_DRAWN = f"""
(SELECT value, ((h >> 11)::DOUBLE + 0.5) / 9007199254740992 AS key
FROM {_KEYED} ORDER BY 2 DESC, 1 LIMIT 512)"""
query("reservoir_sample", f"SELECT * FROM {_DRAWN}")(_sample)
query("reservoir_quantile", f"SELECT round(quantile_cont(value, 0.5), 6) AS quantile FROM {_DRAWN}")(
    lambda s, d: rounded(op.ReservoirHistogram.quantile(_sample(s, d), 0.5))
)
query(
    "reservoir_histogram",
    f"""
WITH s AS (SELECT value, min(value) OVER () AS lo, (max(value) OVER () - min(value) OVER ()) / 20 AS width FROM {_DRAWN}),
k AS (SELECT lo, width, least(floor((value - lo) / width), 19) AS k FROM s)
SELECT round(lo + k * width, 4) AS lower_bound, round(lo + (k + 1) * width, 4) AS upper_bound, count(*)::DOUBLE AS weight
FROM k GROUP BY lo, width, k""",
)(lambda s, d: rounded(op.ReservoirHistogram.histogram(_sample(s, d), 20), 4))
query(
    "hyperloglog",
    f"""
WITH r AS (SELECT (h >> 52)::INT AS idx, max(least(CASE WHEN x = 0 THEN 64 ELSE 64 - length(bin(x::UBIGINT))
END, 52) + 1) AS rho FROM (SELECT h, (h << 12) & {_M} AS x
FROM {_HASHED}) GROUP BY 1), e AS (SELECT (0.7213 / (1 + 1.079 / 4096::DOUBLE)) * 4096 * 4096 / (sum(2.0::DOUBLE
** -rho) + 4096 - count(*)) AS raw, 4096 - count(*) AS empty
FROM r) SELECT round(CASE WHEN raw <= 2.5 * 4096 AND empty > 0 THEN 4096 * ln(4096 / empty::DOUBLE) ELSE raw
END, 5) AS estimate, 12::INT AS precision
FROM e""",
)(lambda s, d: rounded((lambda q: q.read(q.cells(_parts(s, d))))(op.HyperLogLog(12)), 5))
query(
    "linear_counting",
    f"""
SELECT round(-65536::DOUBLE * ln((65536 - count(DISTINCT (h & 65535::UHUGEINT))) / 65536::DOUBLE), 5) AS
estimate, 65536::INT AS bits, 65536 - count(DISTINCT (h & 65535::UHUGEINT)) AS unset_bits
FROM {_HASHED}""",
)(lambda s, d: rounded((lambda q: q.read(q.cells(_parts(s, d))))(op.LinearCounting(65536)), 5))
_BLOOM = f"""
(SELECT DISTINCT ((h + i::UHUGEINT * g) & 65535::UHUGEINT)::BIGINT AS p
FROM {_mix_sql(_HASHED, 'h', 'g')}, (SELECT unnest(range(7)) AS i))"""
query("bloom_words", f"""
SELECT p >> 6 AS word, {_signed_sql('bit_or(1::UHUGEINT << (p & 63)::UHUGEINT)')} AS bits
FROM {_BLOOM} GROUP BY 1""")(lambda s, d: op.BloomFilter().cells(_parts(s, d)))
_PROBES = "(SELECT c_custkey AS k FROM customer)"
query(
    "bloom_contains",
    f"""
SELECT k, bool_and(p IS NOT NULL) AS contained
FROM (SELECT k, ((h + i::UHUGEINT * g) & 65535::UHUGEINT)::BIGINT AS q
FROM {_mix_sql(_mix_sql(_PROBES, 'k::UHUGEINT', 'h'), 'h', 'g')}, (SELECT unnest(range(7)) AS i))
LEFT JOIN {_BLOOM} ON p = q GROUP BY 1""",
)(lambda s, d: op.BloomFilter().contains(op.BloomFilter().cells(_parts(s, d)), read_table(s, d, "customer").select(F.col("c_custkey").alias("k")), "k"))
_SALTS = ", ".join(f"({i}, {_u(x)})" for i, x in enumerate(op.CountMinSketch().salts))
_CMS_KEYS = f"""
(SELECT *, xor(k::UHUGEINT, salt) AS x
FROM (SELECT l_partkey AS k, round_even(l_quantity, 0)::BIGINT AS w
FROM lineitem) l, (VALUES {_SALTS}) s(row, salt))"""
_CMS = f"""
(SELECT row::INT AS row, (h & 1023::UHUGEINT)::INT AS col, sum(w)::BIGINT AS count
FROM {_mix_sql(_CMS_KEYS, 'x', 'h')}
WHERE w > 0 GROUP BY 1, 2)"""
query("cms_cells", f"SELECT * FROM {_CMS}")(lambda s, d: op.CountMinSketch().cells(_parts(s, d, weight="l_quantity")))
_CMS_PROBES = f"(SELECT *, xor(k::UHUGEINT, salt) AS x FROM {_PROBES} l, (VALUES {_SALTS}) s(row, salt))"
query("cms_estimate", f"""
SELECT k, min(coalesce(c.count, 0)) AS estimate
FROM (SELECT k, row::INT AS row, (h & 1023::UHUGEINT)::INT AS col
FROM {_mix_sql(_CMS_PROBES, 'x', 'h')}) p
LEFT JOIN {_CMS} c USING (row, col)
GROUP BY 1""")(
    lambda s, d: op.CountMinSketch().estimate(op.CountMinSketch().cells(_parts(s, d, weight="l_quantity")), read_table(s, d, "customer").select(F.col("c_custkey").alias("k")), "k")
)
_SLOTS = ", ".join(f"({i}, {_u(x)})" for i, x in enumerate(op.MinHash(16).salts))


def _min_sql(where: str) -> str:
    keys = f"""
(SELECT *, xor(k::UHUGEINT, salt) AS x
FROM (SELECT DISTINCT l_partkey AS k
FROM lineitem WHERE {where}) l, (VALUES {_SLOTS}) s(slot, salt))"""
    return f"""
(SELECT slot::INT AS slot, min({_signed_sql('h')}) AS signature
FROM {_mix_sql(keys, 'x', 'h')}
GROUP BY 1)"""


query("minhash_signature", f"SELECT * FROM {_min_sql('true')}")(lambda s, d: op.MinHash(16).cells(_parts(s, d)))


def _half(s, d, flag):
    return discrete(_li(s, d).where(F.col("l_returnflag") == flag), "l_partkey")


_A, _R = "l_returnflag = 'A'", "l_returnflag = 'R'"
query("minhash_jaccard", f"""
SELECT avg((a.signature = b.signature)::INT)::DOUBLE AS jaccard
FROM {_min_sql(_A)} a JOIN {_min_sql(_R)} b USING (slot)""")(
    lambda s, d: op.MinHash(16).jaccard(op.MinHash(16).cells(_half(s, d, "A")), op.MinHash(16).cells(_half(s, d, "R")))
)
query("heavy_hitters", """
SELECT user_id AS key, count(*) AS count, 0::BIGINT AS error
FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(lambda s, d: op.SpaceSaving(20).of(discrete(_ev(s, d), "user_id", seq="event_id")))
query(
    "space_saving_faithful",
    """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT event_type, user_id AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events),
r(event_type, place, s) AS (
  SELECT event_type, 0::BIGINT, []::STRUCT(k BIGINT, c BIGINT, e BIGINT)[] FROM events GROUP BY 1
  UNION ALL
  SELECT r.event_type, e.place,
         CASE WHEN list_contains(list_transform(s, lambda x: x.k), e.k)
              THEN list_transform(s, lambda x: {'k': x.k, 'c': x.c + (x.k = e.k)::BIGINT, 'e': x.e})
              WHEN len(s) < 64 THEN list_append(s, {'k': e.k::BIGINT, 'c': 1::BIGINT, 'e': 0::BIGINT})
              ELSE list_transform(s, lambda x, i: CASE
                WHEN i <> list_position(list_transform(s, lambda y: y.c), list_min(list_transform(s, lambda y: y.c))) THEN x
                ELSE {'k': e.k::BIGINT, 'c': x.c + 1, 'e': x.c} END) END
  FROM r JOIN e ON e.event_type = r.event_type AND e.place = r.place + 1)
SELECT event_type, x.k AS key, x.c AS count, x.e AS error
FROM (SELECT event_type, unnest(arg_max(s, place)) AS x FROM r GROUP BY 1)""",
)(lambda s, d: op.EvictingSpaceSaving(64).of(discrete(_ev(s, d), "user_id", seq="event_id"), _TYPE))

# Adapters

_DIM = "(SELECT label, embedding::DOUBLE[] AS e FROM embeddings)"
for name, sql, make in (
    ("filter_series", "SELECT event_type, round(sum(value), 5) AS sum FROM events WHERE value > 10 GROUP BY 1",
        lambda s, d: run.aggregate(_values(s, d), op.Sum().filter(lambda v: v > 10), _TYPE)),
    ("transform_value", "SELECT event_type, round(sum(value * 2 + 1), 5) AS sum FROM events GROUP BY 1",
        lambda s, d: run.aggregate(_values(s, d), op.Sum().transform_value(lambda v: v * 2 + 1), _TYPE)),
    ("with_value", "SELECT event_type, sum(3.0)::DOUBLE AS sum FROM events WHERE value IS NOT NULL GROUP BY 1",
        lambda s, d: run.aggregate(_values(s, d), op.Sum().with_value(3.0), _TYPE)),
    ("filter_of_transformed", "SELECT event_type, round(sum(value * 2), 5) AS sum FROM events WHERE value * 2 > 30 GROUP BY 1",
        lambda s, d: run.aggregate(_values(s, d), op.Sum().filter(lambda v: v > 30).transform_value(lambda v: v * 2), _TYPE)),
    ("with_weight", "SELECT l_returnflag, round(2 * sum(l_extendedprice), 3) AS sum FROM lineitem GROUP BY 1",
        lambda s, d: run.aggregate(_prices(s, d), op.Sum().with_weight(2.0), _FLAG)),
    ("as_discrete", "SELECT l_returnflag, sum(l_partkey)::DOUBLE AS sum FROM lineitem GROUP BY 1",
        lambda s, d: run.aggregate(_parts(s, d), op.Sum().as_discrete(), _FLAG)),
    ("transform_discrete", "SELECT l_returnflag, sum(l_partkey * 2)::DOUBLE AS sum FROM lineitem GROUP BY 1",
        lambda s, d: run.aggregate(_parts(s, d), op.Sum().as_discrete().transform_value(lambda v: v * 2), _FLAG)),
    ("with_value_discrete", "SELECT l_returnflag, count(*) * 5.0::DOUBLE AS sum FROM lineitem GROUP BY 1",
        lambda s, d: run.aggregate(_parts(s, d), op.Sum().as_discrete().with_value(5), _FLAG)),
    ("filter_discrete", "SELECT l_returnflag, sum(l_partkey)::DOUBLE AS sum FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1",
        lambda s, d: run.aggregate(_parts(s, d), op.Sum().as_discrete().filter(lambda v: v % 2 == 0), _FLAG)),
    ("with_weight_discrete", "SELECT l_returnflag, sum(l_partkey) * 0.5::DOUBLE AS sum FROM lineitem GROUP BY 1",
        lambda s, d: run.aggregate(_parts(s, d), op.Sum().as_discrete().with_weight(0.5), _FLAG)),
    ("at_x", "SELECT l_returnflag, sum(l_quantity)::DOUBLE AS sum FROM lineitem GROUP BY 1",
        lambda s, d: run.aggregate(_pairs(s, d), op.Sum().at_x(), _FLAG)),
    ("at_y", "SELECT l_returnflag, round(sum(l_extendedprice), 3) AS sum FROM lineitem GROUP BY 1",
        lambda s, d: run.aggregate(_pairs(s, d), op.Sum().at_y(), _FLAG)),
    ("fold_paired", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice), 2) AS sum FROM lineitem GROUP BY 1",
        lambda s, d: run.aggregate(_pairs(s, d), op.Sum().fold_paired(lambda x, y: x * y), _FLAG)),
    ("at_index", f"SELECT label, round(sum(e[4]), 5) AS sum FROM {_DIM} GROUP BY 1",
        lambda s, d: run.aggregate(_vectors(s, d), op.Sum().at_index(3), ["label"])),
    ("fold_vector", f"SELECT label, round(sum(list_sum(list_transform(e, lambda x: x * x))), 4) AS sum FROM {_DIM} GROUP BY 1",
        lambda s, d: run.aggregate(_vectors(s, d), op.Sum().fold_vector(lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), ["label"])),
    ("filter_vector", f"SELECT label, round(sum(e[1]), 5) AS sum FROM {_DIM} WHERE e[1] > 0 GROUP BY 1",
        lambda s, d: run.aggregate(_vectors(s, d), op.Sum().at_index(0).filter(lambda v: F.element_at(v, 1) > 0), ["label"])),
    ("transform_vector", f"SELECT label, round(sum(e[1] * 3), 5) AS sum FROM {_DIM} GROUP BY 1",
        lambda s, d: run.aggregate(_vectors(s, d), op.Sum().at_index(0).transform_vector(lambda v: F.transform(v, lambda x: x * 3)), ["label"])),
    ("with_weight_vector", f"SELECT label, round(sum(e[1]) * 0.5, 5) AS sum FROM {_DIM} GROUP BY 1",
        lambda s, d: run.aggregate(_vectors(s, d), op.Sum().at_index(0).with_weight(0.5), ["label"])),
):
    query(name, sql)(lambda s, d, make=make, digits={"with_weight": 3, "at_y": 3, "fold_paired": 2, "fold_vector": 4}.get(name, 5): rounded(make(s, d), digits))


_COV = "round(covar_pop(y, x), 3) AS covariance, round(avg(x), 5) AS mean_x, round(avg(y), 4) AS mean_y"


def _cov(df: DataFrame) -> DataFrame:
    keys = [c for c in df.columns if c in ("l_returnflag", "event_type", "label")]
    return rounded(df.select(*keys, "covariance", "mean_x", "mean_y"), 5, covariance=3, mean_y=4)


for name, sql, make in (
    ("filter_paired", f"""
SELECT l_returnflag, {_COV} FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y
FROM lineitem) WHERE x > 10 AND y > 1000
GROUP BY 1""", lambda s, d: run.aggregate(_pairs(s, d), op.Covariance().filter(lambda x, y: (x > 10) & (y > 1000)), _FLAG)),
    ("transform_pair", f"""
SELECT l_returnflag, {_COV} FROM (SELECT l_returnflag, l_quantity + 1 AS x, l_extendedprice / 100 AS y
FROM lineitem) GROUP BY 1""",
    lambda s, d: run.aggregate(_pairs(s, d), op.Covariance().transform_pair(lambda x, y: (x + 1, y / 100)), _FLAG)),
    ("transform_x", f"""
SELECT l_returnflag, {_COV} FROM (SELECT l_returnflag, l_quantity * 2 AS x, l_extendedprice AS y
FROM lineitem) GROUP BY 1""", lambda s, d: run.aggregate(_pairs(s, d), op.Covariance().transform_x(lambda x: x * 2), _FLAG)),
    ("transform_y", f"""
SELECT l_returnflag, {_COV} FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 10 AS y
FROM lineitem) GROUP BY 1""", lambda s, d: run.aggregate(_pairs(s, d), op.Covariance().transform_y(lambda y: y / 10), _FLAG)),
    ("with_weight_paired", f"""
SELECT l_returnflag, {_COV} FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y
FROM lineitem) GROUP BY 1""", lambda s, d: run.aggregate(_pairs(s, d), op.Covariance().with_weight(2.0), _FLAG)),
    ("at_indices", f"SELECT label, {_COV} FROM (SELECT label, e[1] AS x, e[2] AS y FROM {_DIM}) GROUP BY 1",
        lambda s, d: run.aggregate(_vectors(s, d), op.Covariance().at_indices(0, 1), ["label"])),
    ("fixed_x", f"SELECT event_type, {_COV} FROM (SELECT event_type, 2.0::DOUBLE AS x, value AS y FROM events) GROUP BY 1",
        lambda s, d: run.aggregate(_values(s, d), op.Covariance().with_fixed_x(2.0), _TYPE)),
    ("fixed_y", f"SELECT event_type, {_COV} FROM (SELECT event_type, value AS x, 2.0::DOUBLE AS y FROM events) GROUP BY 1",
        lambda s, d: run.aggregate(_values(s, d), op.Covariance().with_fixed_y(2.0), _TYPE)),
):
    query(name, sql)(lambda s, d, make=make: _cov(make(s, d)))

_T0 = """
(SELECT event_type, value, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6::DOUBLE AS t
FROM events WHERE value IS NOT NULL)"""


def _since(s, d):
    e = _values(s, d)
    first = e.df.agg(F.min("ts_nanos")).first()[0]
    return series(_ev(s, d), "value", ts=F.col("ts_nanos") - F.lit(first))


query("time_as_x", f"SELECT event_type, round(regr_slope(value, t) * 1e6, 4) AS slope FROM {_T0} GROUP BY 1")(
    lambda s, d: rounded(run.aggregate(_since(s, d), op.OLS().with_time_as_x(), _TYPE).select("event_type", (F.col("slope") * 1e6).alias("slope")), 4)
)
query("time_as_y", f"SELECT event_type, round(regr_slope(t, value), 2) AS slope FROM {_T0} GROUP BY 1")(
    lambda s, d: rounded(run.aggregate(_since(s, d), op.OLS().with_time_as_y(), _TYPE).select("event_type", "slope"), 2)
)
query("as_series", """
SELECT event_type, trunc(value)::BIGINT AS key, count(*) AS count, 0::BIGINT AS error
FROM events WHERE value IS NOT NULL
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_type
ORDER BY count(*) DESC, trunc(value)::BIGINT) <= 5""")(
    lambda s, d: op.SpaceSaving(5).as_series().of(_values(s, d), _TYPE)
)
for kind, events, base, by, sql in (
    ("series", _values, lambda: op.Mean(), _TYPE, "SELECT event_type, round(avg(value) * 100, 4) AS per_cent FROM events GROUP BY 1"),
    ("discrete", _parts, lambda: op.Mean().as_discrete(), _FLAG, "SELECT l_returnflag, round(avg(l_partkey) * 100, 4) AS per_cent FROM lineitem GROUP BY 1"),
    ("paired", _pairs, lambda: op.Mean().at_x(), _FLAG, "SELECT l_returnflag, round(avg(l_quantity) * 100, 4) AS per_cent FROM lineitem GROUP BY 1"),
    ("vector", _vectors, lambda: op.Mean().at_index(0), ["label"], f"SELECT label, round(avg(e[1]) * 100, 4) AS per_cent FROM {_DIM} GROUP BY 1"),
):
    query(f"map_result_{kind}", sql)(
        lambda s, d, events=events, base=base, by=by: rounded(run.aggregate(events(s, d), base().map_result(lambda r: {"per_cent": r["mean"] * 100}), by), 4)
    )


@query("vector_means", f"""
SELECT label, dim::INT - 1 AS dim, count(*)::DOUBLE AS total_weights, round(avg(v), 6) AS mean
FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS dim
FROM {_DIM}) GROUP BY 1, 2""")
def vector_means(s, d):
    e = _vectors(s, d)
    size = e.df.select(F.max(F.size("embedding"))).first()[0]
    return rounded(run.per_dimension(e, lambda i: op.Mean(), size, ["label"]))


# Windows

_SLICE = 3_600_000_000_000
_LAST = f"""
(SELECT *, ts_n // {_SLICE} AS slice, max(ts_n) OVER () AS t
FROM (SELECT *, {_NANOS} AS ts_n
FROM events WHERE value IS NOT NULL))"""


def _live_sql(by: str) -> str:
    """Events in the slices that a reading at the newest time takes."""
    over = f"PARTITION BY {by}" if by else ""
    return f"""
(SELECT * FROM (SELECT *, max(slice) OVER ({over + ', ' if over else 'PARTITION BY '}slice % 24) AS newest_here
FROM {_LAST}) WHERE slice = newest_here AND slice * {_SLICE} BETWEEN t - 24 * {_SLICE} AND t)"""


def _window(declaration, events, by):
    w = windowed(declaration, timedelta(days=1), 24)
    last = events.df.agg(F.max(events.row.ts)).first()[0]
    return w.read(w.state(events, by), last, by)


query("windowed_sum", f"SELECT event_type, round(sum(value), 5) AS sum FROM {_live_sql('event_type')} GROUP BY 1")(
    lambda s, d: rounded(_window(op.Sum(), _values(s, d), _TYPE), 5)
)
query("windowed_mean", f"""
SELECT event_type, count(*)::DOUBLE AS total_weights, round(avg(value), 6) AS mean
FROM {_live_sql('event_type')} GROUP BY 1""")(lambda s, d: rounded(_window(op.Mean(), _values(s, d), _TYPE)))
query("windowed_variance", f"SELECT event_type, round(var_pop(value), 4) AS variance FROM {_live_sql('event_type')} GROUP BY 1")(
    lambda s, d: rounded(_window(op.Variance(), _values(s, d), _TYPE).select("event_type", "variance"), 4)
)
query("windowed_paired", f"""
SELECT event_type, round(covar_pop(value, user_id), 3) AS covariance
FROM {_live_sql('event_type')} GROUP BY 1""")(
    lambda s, d: rounded(_window(op.Covariance(), paired(_ev(s, d), "user_id", "value", ts="ts_nanos"), _TYPE).select("event_type", "covariance"), 3)
)
query("windowed_vector", f"SELECT event_type, round(sum(value * 2), 4) AS sum FROM {_live_sql('event_type')} GROUP BY 1")(
    lambda s, d: rounded(_window(op.Sum().at_index(1), vector(_ev(s, d).where("value is not null"), F.array(F.lit(0.0), F.col("value") * 2), ts="ts_nanos"), _TYPE), 4)
)
_WINDOW_KEYS = _mix_sql(f"(SELECT DISTINCT user_id AS k FROM {_live_sql('')})", "k::UHUGEINT", "h")
query("windowed_cardinality", f"""
SELECT round(-4096::DOUBLE * ln((4096 - count(DISTINCT (h & 4095::UHUGEINT))) / 4096::DOUBLE), 5) AS estimate,
4096::INT AS bits, 4096 - count(DISTINCT (h & 4095::UHUGEINT)) AS unset_bits
FROM {_WINDOW_KEYS}""")(
    lambda s, d: rounded(_window(op.LinearCounting(), discrete(_ev(s, d).where("value is not null"), "user_id", ts="ts_nanos"), []), 5)
)

# Groups


@query("stat_group", """
SELECT event_type, round(sum(value), 5) AS total, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean,
max(value) AS most FROM events WHERE value IS NOT NULL
GROUP BY 1""")
def stat_group(s, d):
    g = StatGroup(stat("total", op.Sum()), stat("n", op.Count()), stat("mean", op.Mean()), stat("range", op.Range()))
    got = g.aggregate(_values(s, d), _TYPE)
    return rounded(got.select("event_type", F.col("total.sum").alias("total"), F.col("n.sum").alias("n"), F.col("mean.mean").alias("mean"), F.col("range.max").alias("most")), 6, total=5)


class Traffic(StatSchema):
    requests = op.Count()

    class size(StatSchema):
        total = op.Sum()
        spread = op.Variance()


@query("nested_schema", """
SELECT event_type, count(*)::DOUBLE AS requests, round(sum(value), 5) AS total, round(var_pop(value), 4) AS
variance FROM events WHERE value IS NOT NULL
GROUP BY 1""")
def nested_schema(s, d):
    got = Traffic.group().aggregate(_values(s, d), _TYPE)
    return rounded(got.select("event_type", F.col("requests.sum").alias("requests"), F.col("size.total.sum").alias("total"), F.col("size.spread.variance").alias("variance")), 5, variance=4)


@query(
    "list_stats",
    """
SELECT event_type, 0::INT AS pos, 'Count' AS name, round(count(*), 6)::DOUBLE AS result FROM events WHERE value IS NOT NULL GROUP BY 1
UNION ALL SELECT event_type, 1, 'Max', max(value) FROM events GROUP BY 1
UNION ALL SELECT event_type, 2, 'SpaceSaving', sum(n)::DOUBLE FROM (
  SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL
  GROUP BY event_type, trunc(value)::BIGINT QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, trunc(value)::BIGINT) <= 3)
GROUP BY 1""",
)
def list_stats(s, d):
    """The rows of a list, their JSON read again: a number each."""
    got = ListStats(op.Count(), op.Max(), op.SpaceSaving(3).as_series()).rows(_values(s, d), _TYPE)
    one, many = F.from_json("result", "sum double, max double"), F.from_json("result", "array<struct<count: bigint>>")
    total = F.aggregate(many["count"], F.lit(0).cast("long"), lambda a, n: a + n).cast("double")
    return got.select("event_type", "pos", "name", F.coalesce(one["sum"], one["max"], total).alias("result"))


def _list(name, events, members, by, sql, pick):
    query(name, sql)(
        lambda s, d: rounded(ListStats(*members()).aggregate(events(s, d), by).select(*by, *(F.col(c).alias(n) for n, c in pick.items())), 3)
    )


_list("paired_list_stats", _pairs, lambda: (op.OLS(), op.Covariance()), _FLAG, """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
round(covar_pop(l_extendedprice, l_quantity), 3) AS covariance
FROM lineitem GROUP BY 1""", {"slope": "OLS.slope", "covariance": "Covariance.covariance"})
_list("vector_list_stats", _vectors, lambda: (("a", op.Sum().at_index(0)), ("b", op.Max().at_index(1))), ["label"], f"SELECT label, round(sum(e[1]), 3) AS a, round(max(e[2]), 3) AS b FROM {_DIM} GROUP BY 1", {"a": "a.sum", "b": "b.max"})
_list("discrete_list_stats", _parts, lambda: (("a", op.Sum().as_discrete()), ("b", op.Max().as_discrete())), _FLAG, "SELECT l_returnflag, sum(l_partkey)::DOUBLE AS a, max(l_partkey)::DOUBLE AS b FROM lineitem GROUP BY 1", {"a": "a.sum", "b": "b.max"})


@query("group_with_sketch", f"""
SELECT 'x' AS one, count(*)::DOUBLE AS n, (SELECT count(DISTINCT (h & 4095::UHUGEINT))
FROM {_HASHED}) AS used FROM lineitem""")
def group_with_sketch(s, d):
    g = StatGroup(stat("n", op.Count().as_discrete()), group("keys", stat("distinct", op.LinearCounting())))
    got = g.aggregate(_parts(s, d))
    return got.select(F.lit("x").alias("one"), F.col("n.sum").alias("n"), (F.lit(4096) - F.col("keys.distinct.unset_bits")).alias("used"))


# States


@query("merge_states", """
SELECT l_returnflag, sum(l_quantity)::DOUBLE AS total_weights, round(max(m), 4) AS mean, round(sum(w * (v - m)
** 2) / sum(w), 1) AS variance FROM (SELECT l_returnflag, l_quantity, v, w, m
FROM (SELECT l_returnflag, l_quantity, l_extendedprice AS v, l_quantity AS w, sum(l_extendedprice * l_quantity)
OVER g / sum(l_quantity) OVER g AS m
FROM lineitem WINDOW g AS (PARTITION BY l_returnflag)))
GROUP BY 1""")
def merge_states(s, d):
    stats = {"result": op.Variance()}
    halves = [run.states(series(_li(s, d).where(F.col("l_orderkey") % 2 == k), "l_extendedprice", weight="l_quantity"), stats, _FLAG) for k in (0, 1)]
    return rounded(run.read(run.merge(halves, stats, _FLAG), stats, _FLAG).select("l_returnflag", "result.total_weights", "result.mean", "result.variance"), 4, variance=1)


@query("merge_regression", f"SELECT l_returnflag, round(sxy / sxx, 5) AS slope, round(sxy * sxy / sxx / syy, 6) AS r_squared {_REGR}")
def merge_regression(s, d):
    stats = {"result": op.OLS()}
    halves = [run.states(paired(_li(s, d).where(F.col("l_orderkey") % 2 == k), "l_quantity", "l_extendedprice"), stats, _FLAG) for k in (0, 1)]
    return rounded(run.read(run.merge(halves, stats, _FLAG), stats, _FLAG).select("l_returnflag", "result.slope", "result.r_squared"), 6, slope=5)


@query("merge_sketches", f"SELECT * FROM {_DD}")
def merge_sketches(s, d):
    q, c = op.DDSketch(), read_table(s, d, "customer")
    return q.merge([q.cells(series(c.where(F.col("c_custkey") % 2 == k), "c_acctbal")) for k in (0, 1)])


# Groups and windows of all kinds

_LEFT = f"exp(-{_ALPHA!r}::DOUBLE * (t - ts_n)::DOUBLE)"
query("windowed_decaying_sum", f"""
SELECT event_type, round(sum(value * {_LEFT}), 5) AS sum, max(t)::BIGINT AS timestamp_nanos
FROM {_live_sql('event_type')} GROUP BY 1""")(
    lambda s, d: rounded(_window(op.DecayingSum(_DAY), _values(s, d), _TYPE), 5)
)
query("windowed_decaying_mean", f"""
SELECT event_type, round(sum(value * {_LEFT}) / sum({_LEFT}), 6) AS mean
FROM {_live_sql('event_type')} GROUP BY 1""")(
    lambda s, d: rounded(_window(op.DecayingMean(_DAY), _values(s, d), _TYPE).select("event_type", "mean"))
)
query(
    "windowed_heavy_hitters",
    f"""
SELECT user_id AS key, count(*) AS count, 0::BIGINT AS error
FROM (SELECT slice, user_id, count(*) OVER (PARTITION BY user_id) AS n FROM {_live_sql('')}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)(lambda s, d: _window(op.SpaceSaving(1 << 20), discrete(_ev(s, d).where("value is not null"), "user_id", ts="ts_nanos"), []).orderBy(F.desc("count"), "key").limit(10))


@query(
    "windowed_group",
    f"""
SELECT event_type, round(sum(value), 5) AS total, count(*)::DOUBLE AS n, max(value) AS most, round(sum(value * {_LEFT}), 5) AS aged
FROM {_live_sql('event_type')} GROUP BY 1""",
)
def windowed_group(s, d):
    g = StatGroup(stat("total", op.Sum()), group("more", stat("n", op.Count()), stat("most", op.Max())), stat("aged", op.DecayingSum(_DAY)))
    got = _window(g, _values(s, d), _TYPE)
    return rounded(got.select("event_type", F.col("total.sum").alias("total"), F.col("more.n.sum").alias("n"), F.col("more.most.max").alias("most"), F.col("aged.sum").alias("aged")), 5)


@query(
    "vector_weighted",
    f"""
SELECT label, dim::INT - 1 AS dim, round(sum(v * dim), 5) AS sum
FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS dim FROM {_DIM}) WHERE dim <= 4 GROUP BY 1, 2""",
)
def vector_weighted(s, d):
    """A template that differs between dimensions."""
    e = vector(read_table(s, d, "embeddings"), F.slice("embedding", 1, 4))
    return rounded(run.per_dimension(e, lambda i: op.Sum().with_weight(i + 1), 4, ["label"]), 5)


@query(
    "vectorized_group",
    f"""
SELECT label, round(sum(e[1]), 5) AS a, round(max(e[2]), 5) AS b, count(*) FILTER (e[3] >= 0)::DOUBLE AS c
FROM {_DIM} GROUP BY 1""",
)
def vectorized_group(s, d):
    """Statistics of another kind for each dimension, one of them a sketch."""
    e = vector(read_table(s, d, "embeddings"), F.slice("embedding", 1, 3))
    got = Vectorized(3, lambda i: (op.Sum(), op.Max(), op.LinearHistogram(0, 1e9, 1).filter(lambda v: v >= 0))[i]).aggregate(e, ["label"])
    return rounded(got.select("label", F.col("`0`.sum").alias("a"), F.col("`1`.max").alias("b"), F.aggregate(F.col("`2`.weight"), F.lit(0.0), lambda a, w: a + w).alias("c")), 5)


def _halves(s, d, **more):
    return [series(_ev(s, d).where(F.col("event_id") % 2 == k), "value", ts="ts_nanos", seq="event_id", **more) for k in (0, 1)]


@query(
    "group_states_with_sketch",
    f"""
SELECT event_type, round(sum(value), 5) AS total, count(*)::DOUBLE AS n, min(bins) AS bins, min(top) AS top
FROM events JOIN (SELECT event_type, count(DISTINCT floor(value / 10)) AS bins FROM events WHERE value >= 0 AND value < 1000 GROUP BY 1) USING (event_type)
JOIN (SELECT event_type, max(c) AS top FROM (SELECT event_type, trunc(value)::BIGINT AS k, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (event_type)
WHERE value IS NOT NULL GROUP BY 1""",
)
def group_states_with_sketch(s, d):
    """Stored states of a group with a flat, a keyed and an ordered member, merged and read."""
    g = StatGroup(stat("total", op.Sum()), group("in", stat("n", op.Count()), stat("bins", op.LinearHistogram(0, 1000, 100).filter(lambda v: (v >= 0) & (v < 1000)))), stat("top", op.SpaceSaving(1 << 20).as_series()))
    got = g.read(g.merge([g.states(e, _TYPE) for e in _halves(s, d)], _TYPE), _TYPE)
    most = F.array_max(F.transform("top", lambda x: x["count"]))
    return rounded(got.select("event_type", F.col("total.sum").alias("total"), F.col("in.n.sum").alias("n"), F.size("in.bins").cast("long").alias("bins"), most.alias("top")), 5)


@query("group_adapters", """
SELECT event_type, round(sum(value * 2), 5) AS total, count(*)::DOUBLE AS n, round(sum(value * 2) / count(*), 5)
AS share FROM events WHERE value > 10
GROUP BY 1""")
def group_adapters(s, d):
    """A filter, a transform and a result mapping of a whole group."""
    g = StatGroup(stat("total", op.Sum()), stat("n", op.Count())).transform_value(lambda v: v * 2).filter(lambda v: v > 10)
    got = g.map_result(lambda m: {"total": m["total"]["sum"], "n": m["n"]["sum"], "share": m["total"]["sum"] / m["n"]["sum"]}).aggregate(_values(s, d), _TYPE)
    return rounded(got.where("n > 0"), 5)


@query(
    "group_with_ordered",
    """
SELECT event_type, round(sum((1 - exp(-0.05::DOUBLE)) * value * exp(-0.05::DOUBLE * later)) / (1 - exp(-0.05::DOUBLE * count(*))), 6) AS ewma, round(sum(value), 5) AS total
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS later FROM events WHERE value IS NOT NULL) GROUP BY 1""",
)
def group_with_ordered(s, d):
    got = StatGroup(stat("ewma", op.EwmaMean(0.05)), stat("total", op.Sum())).aggregate(_values(s, d), _TYPE)
    return rounded(got.select("event_type", F.col("ewma.mean").alias("ewma"), F.col("total.sum").alias("total")), 6, total=5)


@query("paired_group", f"SELECT l_returnflag, round(sxy / sxx, 5) AS slope, round(sxy / n, 3) AS covariance {_REGR}")
def paired_group(s, d):
    g = StatGroup(stat("line", op.OLS()), stat("both", op.Covariance()))
    return rounded(g.aggregate(_pairs(s, d), _FLAG).select("l_returnflag", F.col("line.slope").alias("slope"), F.col("both.covariance").alias("covariance")), 5, covariance=3)


@query("vector_group", f"SELECT label, round(sum(e[1]), 5) AS a, round(avg(e[2]), 6) AS b FROM {_DIM} GROUP BY 1")
def vector_group(s, d):
    g = StatGroup(stat("a", op.Sum()), stat("b", op.Mean()))
    g.members = {"a": g.members["a"].at_index(0), "b": g.members["b"].at_index(1)}
    return rounded(g.aggregate(_vectors(s, d), ["label"]).select("label", F.col("a.sum").alias("a"), F.col("b.mean").alias("b")), 6, a=5)


@query("list_merge", "SELECT event_type, count(value)::DOUBLE AS n, max(value) AS most FROM events GROUP BY 1")
def list_merge(s, d):
    g = ListStats(op.Count(), op.Max())
    got = g.read(g.merge([g.states(e, _TYPE) for e in _halves(s, d)], _TYPE), _TYPE)
    return got.select("event_type", F.col("Count.sum").alias("n"), F.col("Max.max").alias("most"))


def _counter_sql(part: int) -> str:
    return f"""
SELECT user_id, sum(delta) AS total, arg_min(CASE WHEN delta > 0 THEN CASE WHEN v < before THEN ts ELSE since END END, CASE WHEN delta > 0 THEN event_id END) AS start
FROM (SELECT *, coalesce(greatest(CASE WHEN v < before THEN v ELSE v - before END, 0), 0) AS delta
      FROM (SELECT *, lag(v) OVER w AS before, lag(ts) OVER w AS since
            FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late
                  FROM (SELECT user_id, event_id, {_NANOS} AS ts, value AS v FROM events WHERE value IS NOT NULL AND event_id % 2 = {part}))
            WHERE late IS NULL OR ts > late WINDOW w AS (PARTITION BY user_id ORDER BY event_id)))
GROUP BY 1"""


@query(
    "merge_counter_rate",
    f"""
SELECT user_id, round(sum(total), 5) AS total_value, coalesce(min(start) FILTER (total <> 0), (SELECT max({_NANOS}) FROM events WHERE value IS NOT NULL)) AS start_timestamp_nanos
FROM ({_counter_sql(0)} UNION ALL {_counter_sql(1)}) GROUP BY 1""",
)
def merge_counter_rate(s, d):
    c, last = op.CounterRate(), _ev(s, d).where("value is not null").agg(F.max("ts_nanos")).first()[0]
    got = c.read(c.merge([c.state(e, ["user_id"], last) for e in _halves(s, d)], ["user_id"], last), ["user_id"], last)
    return rounded(got.select("user_id", "total_value", "start_timestamp_nanos"), 5)


def _ewma_sql(part: int) -> str:
    share = "(1 - exp(-0.05::DOUBLE)) * exp(-0.05::DOUBLE * later)"
    return f"""
SELECT event_type, w, m / (1 - exp(-0.05::DOUBLE * w)) AS m, (q - m * m) / (1 - exp(-0.05::DOUBLE * w)) AS v, 1 - exp(-0.05::DOUBLE * w) AS c
FROM (SELECT event_type, count(*)::DOUBLE AS w, sum({share} * value) AS m, sum({share} * value * value) AS q
      FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS later
            FROM events WHERE value IS NOT NULL AND event_id % 2 = {part}) GROUP BY 1)"""


@query(
    "merge_ewma_variance",
    f"""
SELECT event_type, a.w + b.w AS total_weights, round((a.c * a.m + b.c * b.m) / (a.c + b.c), 6) AS mean,
       round((a.c * a.v + b.c * b.v + a.c * b.c * (a.m - b.m) ** 2 / (a.c + b.c)) / (a.c + b.c), 6) AS variance
FROM ({_ewma_sql(0)}) a JOIN ({_ewma_sql(1)}) b USING (event_type)""",
)
def merge_ewma_variance(s, d):
    v = op.EwmaVariance(0.05)
    return rounded(v.read(v.merge([v.state(e, _TYPE) for e in _halves(s, d)], _TYPE), _TYPE))


def _frugal_sql(part: int) -> str:
    return f"""
SELECT event_type, list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY event_id)),
  lambda a, v: CASE WHEN v > a THEN a + 0.9::DOUBLE WHEN v < a THEN a - {_DOWN}::DOUBLE ELSE a END) AS q
FROM events WHERE value IS NOT NULL AND event_id % 2 = {part} GROUP BY 1"""


@query("merge_frugal_quantile", f"""
SELECT event_type, 0.9::DOUBLE AS probability, round((a.q + b.q) / 2, 6) AS quantile
FROM ({_frugal_sql(0)}) a JOIN ({_frugal_sql(1)}) b USING (event_type)""")
def merge_frugal_quantile(s, d):
    f = op.FrugalQuantile(0.9, step=1.0)
    return rounded(f.read(f.merge([f.state(e, _TYPE) for e in _halves(s, d)], _TYPE), _TYPE))


assert splitmix64_int(0) == 4553024054441242788
