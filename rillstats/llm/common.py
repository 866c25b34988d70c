"""What the operators of this subpackage share: reading tables, words, and
tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import queue
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters between words.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a class for Java's regular expressions and for DuckDB's.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset (tests, one
    machine) a temporary folder is made and set for the session's life."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="rillstats-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Seconds to wait for what a write has counted. It comes over Spark's listener bus, which may
#: drop events under load; then the table that was written is counted.
WAIT_SECONDS = 60
_waiting: queue.Queue | None = None


def _wait() -> None:
    tasks = _waiting
    while True:
        f, box = tasks.get()
        got = None
        with contextlib.suppress(Exception):
            got = f()
        box.put(got)


def _in_time(f):
    """f() in a thread of its own, or None after WAIT_SECONDS."""
    global _waiting
    if _waiting is None:
        _waiting = queue.Queue()
        threading.Thread(target=_wait, daemon=True).start()
    box: queue.Queue = queue.Queue()
    _waiting.put((f, box))
    try:
        return box.get(timeout=WAIT_SECONDS)
    except queue.Empty:
        _waiting = None  # that thread is lost
        return None


def stored(df: DataFrame, label: str, **sums: Column) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. This cuts the
    lineage, so that a lost executor costs no recomputation of what lies before. Rows are
    counted as they are written, and so are further aggregates: rows_of() and seen_in() have them."""
    spark = df.sparkSession
    path, seen = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", Observation()
    counts = [F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in sums.items())]
    df.observe(seen, *counts).write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path, out._seen = path, _in_time(lambda: seen.get) or out.agg(*counts).first().asDict()
    return out


def seen_in(df: DataFrame, name: str):
    """An aggregate that stored() took."""
    return df._seen[name]


def rows_of(df: DataFrame) -> int:
    """Rows of a table that stored() gave, without a job; of any other one by counting."""
    found = getattr(df, "_seen", None)
    return df.count() if found is None else found["n"]


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that no later plan reads."""
    for df in tables:
        for spark, path in list(_made):
            if path == getattr(df, "_stored_path", None):
                _delete(spark, path)
                _made.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is, also after the session has been stopped."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(p, True)


def _clean() -> None:
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # the JVM has gone first
            return


#: Rows of a few numbers that are broadcast at most (some 40 MB); more are shuffled.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """A stored table of a few narrow columns, marked for broadcast if it is counted to be
    small; otherwise left to a shuffled join. `of` is a stored table that has as many rows or more."""
    return F.broadcast(df) if rows_of(df if of is None else of) <= BROADCAST_ROWS else df


def hash_share(share: float) -> int:
    """The largest 64-bit hash of those that make up a share of all: a share of any size
    has its own bound, however small."""
    low = -(1 << 63)
    return max(low, low + int(min(share, 1.0) * (1 << 64)) - 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(batch, name: str = "text") -> Iterator[bytes]:
    """The batch's texts as UTF-8 bytes, a few at a time; null is empty."""
    import pyarrow as pa

    column = batch.column(name).cast(pa.binary())
    for at in range(0, len(column), 256):
        for text in column.slice(at, 256).to_pylist():
            yield text or b""


def lean(run):
    """run, a function of Arrow batches, after which the worker gives free memory back to the
    system: workers outlive their tasks and wait beside the executor's heap."""

    def task(batches):
        yield from run(batches)
        trim()

    return task


def trim() -> None:
    """Give this process's free memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to `most` words at a time."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _MULTIPLIER
        out += hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return mixed(out)
