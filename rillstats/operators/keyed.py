"""Sketches whose state is a table of cells: by columns, an index, a value.

Cells are made and merged by ordinary grouped aggregates, so Spark combines them before
the shuffle and no group is held by one task. Each sketch has

    cells(events, by)         the state
    merge([cells, ...], by)   the same of several states
    read(cells, by)           results

Only parameters live in the declaration; states of different parameters don't merge."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import splitmix64_int, with_splitmix64, wrapped_add, wrapped_times
from ..plans.run import join_by
from ..plans.stat import Events, Row, Stat

PROBABILITIES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
LARGEST = 2**63 - 1


class Keyed(Stat):
    kind = "keyed"
    #: Columns of a cell's index, and the aggregate that joins cells.
    index: tuple[str, ...] = ("idx",)
    cell = "value"

    def parts(self, events: Events, by: list[str]) -> DataFrame:
        """by, index columns and a value, one row or more an event."""
        raise NotImplementedError

    def joined(self, c: Column) -> Column:
        return F.sum(c)

    def cells(self, events: Events, by: list[str] = ()) -> DataFrame:
        return self._grouped(self.parts(events, list(by)), by)

    def merge(self, states: list[DataFrame], by: list[str] = ()) -> DataFrame:
        every = states[0]
        for s in states[1:]:
            every = every.unionByName(s)
        return self._grouped(every, by)

    def _grouped(self, df: DataFrame, by) -> DataFrame:
        return df.groupBy(*by, *self.index).agg(self.joined(F.col(self.cell)).alias(self.cell))

    def live(self, events: Events, extra: Column | None = None) -> tuple[DataFrame, Row]:
        """Events that count and weigh more than 0."""
        r = self.rows(events.row)
        df = events.df
        for test in (r.accept, None if r.weight is None else r.w > 0, extra):
            if test is not None:
                df = df.where(test)
        return df, r

    def seen(self, events: Events, by: list[str] = ()) -> DataFrame:
        """by and the number of events that the sketch has taken in."""
        return self.live(events)[0].groupBy(*by).agg(F.count(F.lit(1)).alias("total_seen"))

    def _keys(self, events: Events, by: list[str]) -> DataFrame:
        """by and the different keys as _v: a repeated key changes nothing, so it is dropped
        before anything is made of it."""
        df, r = self.live(events)
        return df.select(*by, r.value.cast("long").alias("_v")).distinct()

    def _hashed(self, events: Events, by: list[str]) -> DataFrame:
        return with_splitmix64(self._keys(events, by), F.col("_v"), "_h")


def _bits_of(size: int) -> int:
    if size < 2 or size & (size - 1):
        raise ValueError("a power of two is needed")
    return size.bit_length() - 1


# Cardinality


class HyperLogLog(Keyed):
    """Distinct keys by 2^precision registers. With few keys empty registers are counted."""

    modality, single = "discrete", True
    index, cell = ("idx",), "rho"

    def __init__(self, precision: int = 14):
        super().__init__()
        if not 4 <= precision <= 18:
            raise ValueError("precision must be 4 to 18")
        self.precision = precision

    def parts(self, events, by):
        h, p = self._hashed(events, by), self.precision
        rest = F.shiftleft("_h", p)
        zeros = F.when(rest == 0, F.lit(64)).otherwise(F.lit(64) - F.length(F.conv(rest.cast("string"), 10, 2)))
        return h.select(*by, F.shiftrightunsigned("_h", 64 - p).cast("int").alias("idx"), (F.least(zeros, F.lit(64 - p)) + 1).cast("int").alias("rho"))

    def joined(self, c):
        return F.max(c)

    def read(self, cells: DataFrame, by: list[str] = ()) -> DataFrame:
        m = 1 << self.precision
        alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
        sums = cells.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho").cast("double"))).alias("s"), F.count(F.lit(1)).alias("filled"))
        empty = F.lit(m) - F.col("filled")
        raw = F.lit(alpha * m * m) / (F.coalesce("s", F.lit(0.0)) + empty)
        few = F.lit(float(m)) * F.log(F.lit(float(m)) / F.when(empty > 0, empty))
        return sums.select(*by, F.when((raw <= 2.5 * m) & (empty > 0), few).otherwise(raw).alias("estimate"), F.lit(self.precision).alias("precision"))


class LinearCounting(Keyed):
    """Distinct keys by a bit map; +Infinity once it is full."""

    modality, single = "discrete", True
    index, cell = ("word",), "bits"

    def __init__(self, bits: int = 4096):
        super().__init__()
        _bits_of(bits)
        if bits < 64:
            raise ValueError("64 bits or more are needed")
        self.bits = bits

    def parts(self, events, by):
        bit = F.col("_h").bitwiseAND(F.lit(self.bits - 1))
        return self._hashed(events, by).select(*by, F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, int(_h & {self.bits - 1} & 63))").alias("bits"))

    def joined(self, c):
        return F.bit_or(c)

    def read(self, cells: DataFrame, by: list[str] = ()) -> DataFrame:
        used = cells.groupBy(*by).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("used"))
        unset = F.lit(self.bits) - F.col("used")
        estimate = F.when(unset > 0, -F.lit(float(self.bits)) * F.log(F.when(unset > 0, unset) / F.lit(float(self.bits)))).otherwise(F.lit(math.inf))
        return used.select(*by, (estimate + F.lit(0.0)).alias("estimate"), F.lit(self.bits).alias("bits"), unset.alias("unset_bits"))


# Membership, frequency, similarity


class BloomFilter(Keyed):
    """A set that may hold more than was put in but never less."""

    modality = "discrete"
    index, cell = ("word",), "bits"

    def __init__(self, bits: int = 65536, hashes: int = 7):
        super().__init__()
        _bits_of(bits)
        self.bits, self.hashes = bits, hashes

    def positions(self, df: DataFrame, value: Column) -> DataFrame:
        """df with _at: the positions of a value."""
        two = with_splitmix64(with_splitmix64(df, value, "_h1"), F.col("_h1"), "_h2")
        at = [wrapped_add(F.col("_h1"), wrapped_times(F.col("_h2"), i)).bitwiseAND(F.lit(self.bits - 1)) for i in range(self.hashes)]
        return two.withColumn("_at", F.array(*at)).drop("_h1", "_h2")

    def parts(self, events, by):
        at = self.positions(self._keys(events, by), F.col("_v")).select(*by, F.explode_outer("_at").alias("_p"))
        return at.select(*by, F.shiftright("_p", 6).alias("word"), F.expr("shiftleft(1L, int(_p & 63))").alias("bits"))

    def joined(self, c):
        return F.bit_or(c)

    def contains(self, cells: DataFrame, probes: DataFrame, value: str) -> DataFrame:
        """probes with `contained`. cells: of one filter, without by columns. There are
        bits / 64 words at most, which are joined by position."""
        keyed = self.positions(probes.withColumn("_row", F.monotonically_increasing_id()), F.col(value))
        each = keyed.select("_row", F.explode_outer("_at").alias("_p")).withColumn("word", F.shiftright("_p", 6))
        hit = F.coalesce(F.expr("bits & shiftleft(1L, int(_p & 63))") != 0, F.lit(False))
        return self._judged(keyed, each.join(cells, "word", "left").groupBy("_row").agg(F.min(hit).alias("contained")), probes)

    def _judged(self, keyed: DataFrame, found: DataFrame, probes: DataFrame) -> DataFrame:
        return keyed.join(found, "_row").select(*probes.columns, "contained")

    def read(self, cells: DataFrame, by: list[str] = ()) -> DataFrame:
        return cells


class CountMinSketch(Keyed):
    """Counts by key that are never too low. Weights are rounded to whole numbers, halves to even."""

    modality = "discrete"
    index, cell = ("row", "col"), "count"
    SEED = -7046029254386353133  # fixed value

    def __init__(self, depth: int = 5, width: int = 1024, seed: int = SEED):
        super().__init__()
        _bits_of(width)
        self.depth, self.width, self.seed = depth, width, seed
        self.salts = [splitmix64_int(seed + i) for i in range(depth)]

    def columns(self, df: DataFrame, value: Column) -> DataFrame:
        for i, salt in enumerate(self.salts):
            df = with_splitmix64(df, value.bitwiseXOR(F.lit(salt)), f"_c{i}")
        at = F.array(*(F.struct(F.lit(i).alias("row"), F.col(f"_c{i}").bitwiseAND(F.lit(self.width - 1)).cast("int").alias("col")) for i in range(self.depth)))
        return df.withColumn("_at", at).drop(*(f"_c{i}" for i in range(self.depth)))

    def parts(self, events, by):
        r = self.rows(events.row)
        whole = F.rint(r.w).cast("long")
        df, r = self.live(events, whole > 0)
        # A key's weights are summed up before it is made into a cell for each row.
        sums = df.select(*by, r.value.alias("_v"), whole.alias("_n")).groupBy(*by, "_v").agg(F.sum("_n").alias("count"))
        at = self.columns(sums, F.col("_v"))
        return at.select(*by, F.explode_outer("_at").alias("_p"), "count").select(*by, "_p.row", "_p.col", "count")

    def estimate(self, cells: DataFrame, probes: DataFrame, value: str) -> DataFrame:
        """probes with `estimate`. cells: of one sketch, without by columns."""
        keyed = self.columns(probes.withColumn("_row", F.monotonically_increasing_id()), F.col(value))
        each = keyed.select("_row", F.explode_outer("_at").alias("_p")).select("_row", "_p.row", "_p.col")
        found = each.join(cells, ["row", "col"], "left").groupBy("_row").agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))
        return keyed.join(found, "_row").select(*probes.columns, "estimate")

    def read(self, cells: DataFrame, by: list[str] = ()) -> DataFrame:
        return cells


class MinHash(Keyed):
    """The smallest of each of `hashes` hashes, compared as signed numbers."""

    modality = "discrete"
    index, cell = ("slot",), "signature"
    SEED = -3724518991637283867  # fixed value

    def __init__(self, hashes: int = 128, seed: int = SEED):
        super().__init__()
        self.hashes, self.seed = hashes, seed
        self.salts = [splitmix64_int(seed + i) for i in range(hashes)]

    def parts(self, events, by):
        salts = F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(s).alias("salt")) for i, s in enumerate(self.salts)))
        each = self._keys(events, by).select(*by, "_v", F.explode(salts).alias("_s"))
        return with_splitmix64(each, F.col("_v").bitwiseXOR(F.col("_s.salt")), "signature").select(*by, F.col("_s.slot").alias("slot"), "signature")

    def joined(self, c):
        return F.min(c)

    def read(self, cells: DataFrame, by: list[str] = ()) -> DataFrame:
        return cells

    def jaccard(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """The share of equal slots of two signatures, 0 if none is filled."""
        same = a.select("slot", F.col("signature").alias("_a")).join(b.select("slot", F.col("signature").alias("_b")), "slot")
        return same.agg(F.coalesce(F.avg((F.col("_a") == F.col("_b")).cast("double")), F.lit(0.0)).alias("jaccard"))


# Quantiles


def quantile_of(bins: DataFrame, by: list[str], order: str, value: Column, probabilities, weight: str = "value") -> DataFrame:
    """For each probability the value of the first bin whose summed weight reaches its share.
    The running sum is over bins, of which there are few."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = bins.groupBy(*by).agg(F.sum(weight).alias("_total"))
    summed = bins.withColumn("_cum", F.sum(weight).over(w))
    summed = join_by(summed, whole, by)
    each = [F.min_by(value, F.when(F.col("_cum") >= F.lit(p) * F.col("_total"), F.col(order))).alias(f"q{k}") for k, p in enumerate(probabilities)]
    got = summed.groupBy(*by).agg(F.first("_total").alias("total_weights"), *each)
    return got.select(*by, "total_weights", F.posexplode(F.array(*(F.coalesce(F.col(f"q{k}"), F.lit(0.0)) for k in range(len(probabilities))))).alias("_k", "quantile")).select(
        *by, F.element_at(F.array(*map(F.lit, probabilities)), F.col("_k") + 1).alias("probability"), "quantile", "total_weights"
    )


class DDSketch(Keyed):
    """Quantiles with a bounded relative error by logarithmic bins, mirrored below 0. Values
    near 0 and NaN fall in a bin of their own, and infinite ones in the outermost bin of their
    sign, INFINITE, whose value is infinite."""

    INFINITE = 2**31 - 1

    index = ("sign", "idx")

    def __init__(self, relative_error: float = 0.01, probabilities=PROBABILITIES):
        super().__init__()
        if not 0 < relative_error < 1:
            raise ValueError("the relative error must lie between 0 and 1")
        self.gamma = (1 + relative_error) / (1 - relative_error)
        self.probabilities = tuple(probabilities)

    def parts(self, events, by):
        df, r = self.live(events)
        v, size = r.value, F.abs(r.value)
        finite = (size > 0) & ~F.isnan(v) & (size < math.inf)
        idx = F.when(finite, F.ceil(F.log(F.when(finite, size)) / F.lit(math.log(self.gamma)))).when(size == math.inf, F.lit(self.INFINITE)).otherwise(F.lit(0))
        sign = F.when(F.isnan(v), F.lit(0)).otherwise(F.signum(v).cast("int"))
        return df.select(*by, sign.cast("int").alias("sign"), idx.cast("int").alias("idx"), r.w.alias("value"))

    def value_of(self) -> Column:
        finite = F.col("sign") * F.lit(2.0) * F.pow(F.lit(self.gamma), F.col("idx").cast("double")) / F.lit(1 + self.gamma)
        return F.when(F.col("idx") == self.INFINITE, F.col("sign") * F.lit(math.inf)).otherwise(finite)

    def read(self, cells: DataFrame, by: list[str] = (), probabilities=None) -> DataFrame:
        placed = cells.withColumn("_order", F.col("sign").cast("long") * F.lit(1 << 32) + F.col("sign") * F.col("idx"))
        return quantile_of(placed, list(by), "_order", self.value_of(), probabilities or self.probabilities)

    def histogram(self, cells: DataFrame, by: list[str] = ()) -> DataFrame:
        """Bounds and weight of each bin."""
        g, k = F.lit(self.gamma), F.col("idx").cast("double")
        infinite = F.col("idx") == self.INFINITE
        inner, outer = F.when(infinite, F.lit(math.inf)).otherwise(F.pow(g, k - 1)), F.when(infinite, F.lit(math.inf)).otherwise(F.pow(g, k))
        lower = F.when(F.col("sign") > 0, inner).when(F.col("sign") < 0, -outer).otherwise(F.lit(0.0))
        upper = F.when(F.col("sign") > 0, outer).when(F.col("sign") < 0, -inner).otherwise(F.lit(0.0))
        return cells.select(*by, lower.alias("lower_bound"), upper.alias("upper_bound"), F.col("value").alias("weight"))


class LinearHistogram(Keyed):
    """Bins of equal width over [lower, upper), and what lies below (idx -1) and above (idx bins)."""

    def __init__(self, lower: float, upper: float, bins: int):
        super().__init__()
        if not (lower < upper and bins > 0):
            raise ValueError("bounds must be in order and bins more than 0")
        self.lower, self.upper, self.bins = float(lower), float(upper), bins
        self.width = (self.upper - self.lower) / bins

    def parts(self, events, by):
        df, r = self.live(events, ~F.isnan(self.rows(events.row).value))
        v = r.value
        inside = F.least(F.floor((v - F.lit(self.lower)) / F.lit(self.width)), F.lit(self.bins - 1))
        idx = F.when(v < self.lower, F.lit(-1)).when(v >= self.upper, F.lit(self.bins)).otherwise(inside)
        return df.select(*by, idx.cast("int").alias("idx"), r.w.alias("value"))

    def read(self, cells: DataFrame, by: list[str] = ()) -> DataFrame:
        k, low, width = F.col("idx"), F.lit(self.lower), F.lit(self.width)
        lower = F.when(k < 0, F.lit(-math.inf)).otherwise(low + k * width)
        upper = F.when(k >= self.bins, F.lit(math.inf)).otherwise(low + (k + 1) * width)
        return cells.select(*by, lower.alias("lower_bound"), upper.alias("upper_bound"), F.col("value").alias("weight"))

    def adopted(self, histogram: DataFrame, by: list[str] = ()) -> DataFrame:
        """Cells of this layout from another layout's result, each bin by its middle."""
        lo, hi = F.col("lower_bound"), F.col("upper_bound")
        mid = F.when(lo == -math.inf, F.lit(-math.inf)).when(hi == math.inf, F.lit(math.inf)).otherwise((lo + hi) / 2)
        rows = histogram.withColumn("_mid", mid)
        return self.cells(Events(rows, Row(value=F.col("_mid"), weight=F.col("weight"))), by)


class HdrHistogram(Keyed):
    """Buckets of whole multiples of a smallest value, with a fixed number of significant
    digits. Negative values and NaN are errors; what is above 2^63 - 1 multiples, infinity too, falls in the
    last bucket."""

    def __init__(self, lowest: float = 0.001, digits: int = 3):
        super().__init__()
        self.lowest, self.digits = lowest, digits
        self.half_bits = math.ceil(math.log2(10**digits))
        self.sub = 2 << self.half_bits

    def parts(self, events, by):
        df, r = self.live(events)
        v = r.value
        checked = F.when((v >= 0) & ~F.isnan(v), v).otherwise(F.raise_error(F.lit("values must be numbers and not below 0")).cast("double"))
        multiple = checked * F.lit(1 / self.lowest)
        units = F.when(multiple >= float(2**63), F.lit(LARGEST)).otherwise(F.when(multiple < float(2**63), multiple).cast("long"))
        based = df.select(*by, units.alias("_u"), r.w.alias("value"))
        # the bucket: how far the value must be shifted to have half_bits + 1 bits at most
        length = F.length(F.conv(F.greatest(F.col("_u"), F.lit(1)).cast("string"), 10, 2))
        shift = F.greatest(length - F.lit(self.half_bits + 1), F.lit(0)).cast("int")
        sub = F.call_function("shiftright", F.col("_u"), shift)
        half = F.lit(1 << self.half_bits)
        return based.select(*by, F.when(shift == 0, sub).otherwise(shift * half + sub).cast("int").alias("idx"), "value")

    def read(self, cells: DataFrame, by: list[str] = ()) -> DataFrame:
        half = 1 << self.half_bits
        k = F.col("idx")
        shift = F.when(k < 2 * half, F.lit(0)).otherwise(F.floor(k / half) - 1).cast("int")
        first = (k - shift * F.lit(half)).cast("double") * F.pow(F.lit(2.0), shift)
        lower = first * F.lit(self.lowest)
        upper = (first + F.pow(F.lit(2.0), shift)) * F.lit(self.lowest)
        return cells.select(*by, lower.alias("lower_bound"), upper.alias("upper_bound"), F.col("value").alias("weight"))


def with_random_key(df: DataFrame, seed: int, row_id: Column, name: str) -> DataFrame:
    """df with a number in (0, 1) that depends on the row's id alone."""
    hashed = with_splitmix64(df, row_id.cast("long").bitwiseXOR(F.lit(splitmix64_int(seed))), name)
    return hashed.withColumn(name, (F.shiftrightunsigned(name, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53)))
