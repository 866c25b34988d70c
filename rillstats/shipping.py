"""Sends this package to the executors, where it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch where the session has Spark's default of 10,000: a document is some
#: kilobytes, and a batch is held by the JVM and by a Python worker.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once for each application, and see
    to it that Arrow batches of documents are small."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if context.applicationId in _done:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rillstats-"), "rillstats.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _done.add(context.applicationId)
