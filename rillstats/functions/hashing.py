"""64-bit hashing with the fixed values below, as native columns and for strings.

Spark raises on 64-bit overflow in ANSI mode, so products are made of 16-bit and 32-bit
limbs that never overflow. Steps are separate projections: Catalyst keeps an expression
that is used more than once in a projection of its own, so each is evaluated once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
INCREMENT = -7046029254386353133
MULTIPLIER_1 = -4658895280553007687
MULTIPLIER_2 = -6534734903238641935

_LOW = 0xFFFFFFFF


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def splitmix64_int(x: int) -> int:
    """The hash of a Python integer, as a signed 64-bit integer."""
    m = 0xFFFFFFFFFFFFFFFF
    z = (x + INCREMENT) & m
    z = ((z ^ (z >> 30)) * _unsigned(MULTIPLIER_1)) & m
    z = ((z ^ (z >> 27)) * _unsigned(MULTIPLIER_2)) & m
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


def splitmix64_array(x: np.ndarray) -> np.ndarray:
    """The same of an array of unsigned 64-bit integers."""
    z = x + np.uint64(_unsigned(INCREMENT))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_unsigned(MULTIPLIER_1))
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_unsigned(MULTIPLIER_2))
    return z ^ (z >> np.uint64(31))


def _lo(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_LOW))


def _hi(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def _joined(hi: Column, lo: Column) -> Column:
    return F.shiftleft(_lo(hi), 32).bitwiseOR(_lo(lo))


def wrapped_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64."""
    lo = _lo(a) + _lo(b)
    return _joined(_hi(a) + _hi(b) + F.shiftright(lo, 32), lo)


def wrapped_times(a: Column, factor: int) -> Column:
    """a * factor modulo 2^64."""
    f = _unsigned(factor)
    low, f0, f1, fh = _lo(a), f & 0xFFFF, (f >> 16) & 0xFFFF, f >> 32
    first, second = low * F.lit(f0), low * F.lit(f1)
    lo = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    hi = F.shiftright(lo, 32) + F.shiftright(second, 16)
    for x, y in ((_hi(a), f & _LOW), (low, fh)):
        hi = hi + _lo(x * F.lit(y & 0xFFFF)) + F.shiftleft((x * F.lit(y >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return _joined(hi, lo)


def with_splitmix64(df: DataFrame, source: Column, name: str) -> DataFrame:
    """df with the hash of a bigint column."""
    out = df.withColumn(name, wrapped_add(source.cast("long"), F.lit(INCREMENT)))
    for shift, factor in ((30, MULTIPLIER_1), (27, MULTIPLIER_2)):
        out = out.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, shift)))
        out = out.withColumn(name, wrapped_times(F.col(name), factor))
    return out.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, 31)))


def hash64_bytes(values: list[bytes]) -> np.ndarray:
    """Hashes of byte strings: the length, then each 8-byte little-endian part folded in."""
    n = len(values)
    sizes = np.fromiter(map(len, values), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    h = sizes.astype(np.uint64)[order]
    whole = -(-sizes[order] // 8)
    starts = np.concatenate([[0], np.cumsum(whole)])[:-1]
    words = np.frombuffer(b"".join(values[k].ljust(-(-len(values[k]) // 8) * 8, b"\0") for k in order), "<u8")
    active = n
    for part in range(int(whole[0]) if n else 0):
        while active and whole[active - 1] <= part:
            active -= 1
        h[:active] = splitmix64_array(h[:active] ^ words[starts[:active] + part])
    out = np.empty(n, np.int64)
    out[order] = h.view(np.int64)
    return out


def hash_by(hasher: Callable[[list[bytes]], np.ndarray | list[int]]):
    """A function of string (their UTF-8) or binary columns by a hash of one's own, which gets a
    batch's byte strings and gives signed 64-bit integers; null stays null."""

    @F.pandas_udf(T.LongType())
    def hashed(values: pd.Series) -> pd.Series:
        known = values.notna()
        raw = [v.encode() if isinstance(v, str) else bytes(v) for v in values[known]]
        return pd.Series(np.asarray(hasher(raw), np.int64), index=values.index[known], dtype="Int64").reindex(values.index)

    return hashed


#: The hash of a string or binary column by hash64_bytes.
hash64 = hash_by(hash64_bytes)
