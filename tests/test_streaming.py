"""Streams give what batches give."""

import math

import pytest
from pyspark.sql import functions as F

from rillstats import operators as op
from rillstats.plans import run
from rillstats.plans.stat import series
from rillstats.streaming import fold_in_order, stream_aggregate, stream_cells

SCHEMA = "k string, t timestamp, v double, w double, seq long"


def rows(n=60):
    from datetime import datetime, timedelta

    return [("ab"[j % 2], datetime(2024, 1, 1) + timedelta(minutes=7 * j), float(j % 11), 1.0 + j % 3, j) for j in range(n)]


def stream(spark, folder, files=3):
    found = rows()
    for j in range(files):
        spark.createDataFrame(found[j::files], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(df, name, mode="complete"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_flat_statistics(spark, tmp_path):
    stats = {"sum": op.Sum(), "variance": op.Variance()}
    live = stream_aggregate(series(stream(spark, str(tmp_path / "a")), "v", weight="w"), stats, ["k"], "t", "1 hour", shift=5.0)
    got = {(r.k, r.window.start): r for r in drained(live, "flat").collect()}
    batch = spark.createDataFrame(rows(), SCHEMA).withColumn("window", F.window("t", "1 hour"))
    for r in run.aggregate(series(batch, "v", weight="w"), stats, ["k", "window"]).collect():
        own = got[r.k, r.window.start]
        assert math.isclose(own["sum"].sum, r["sum"].sum) and math.isclose(own.variance.variance, r.variance.variance, abs_tol=1e-9)


def test_sketch_cells(spark, tmp_path):
    h = op.LinearHistogram(0, 11, 11)
    live = stream_cells(series(stream(spark, str(tmp_path / "b")), "v"), h, ["k"], "t", "2 hours")
    got = {(r.k, r.window.start, r.idx): r.value for r in drained(live, "cells").collect()}
    batch = spark.createDataFrame(rows(), SCHEMA).withColumn("window", F.window("t", "2 hours"))
    assert got == {(r.k, r.window.start, r.idx): r.value for r in h.cells(series(batch, "v"), ["k", "window"]).collect()}


def test_folds_in_order(spark, tmp_path):
    def step(s, v, w):
        a = 1 - math.exp(-0.2 * w)
        return s[0] + w, s[1] + a * (v - s[1])

    df = spark.createDataFrame(rows(), SCHEMA)
    for j in range(3):  # files in order of time
        df.where(f"seq div 20 = {j}").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    live = fold_in_order(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c")), "k", "seq", "v", "w", step, (0.0, 0.0), ["weight", "mean"])
    last = {}
    for r in drained(live, "folds", "update").collect():
        if r.weight >= last.get(r.k, (0, 0))[0]:
            last[r.k] = (r.weight, r.mean)
    for r in op.EwmaMean(0.2).state(series(df, "v", weight="w", seq="seq"), ["k"]).collect():
        assert math.isclose(last[r.k][0], r.state.total_weights) and math.isclose(last[r.k][1], r.state.biased)


def test_a_stream_asks_for_a_shift(spark, tmp_path):
    with pytest.raises(ValueError, match="shift"):
        stream_aggregate(series(stream(spark, str(tmp_path / "d")), "v", weight="w"), {"variance": op.Variance()}, ["k"], "t", "1 hour")
    far = spark.createDataFrame([("a", r[1], 1e9 + k, 1.0, k) for k, r in enumerate(rows(3))], SCHEMA)
    far.write.parquet(str(tmp_path / "e"))
    live = stream_aggregate(series(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e")), "v", weight="w"), {"variance": op.Variance()}, ["k"], "t", "1 day", shift=1e9)
    assert math.isclose(drained(live, "far").first().variance.variance, 2 / 3)
