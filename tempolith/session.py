"""Spark session defaults."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with this engine's defaults; settings already made elsewhere (spark-submit) win."""
    b = SparkSession.builder.appName("tempolith")
    if master:
        b = b.master(master)
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": os.environ.get("TEMPOLITH_DRIVER_MEMORY", "6g"),
    }
    for k, v in (conf | extra).items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()
#: Rows in a batch of Python tasks, where the session has Spark's default: batches of long texts take several
#: times their size outside the heap, which is kept for good.
BATCH_ROWS = "2000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: And about so many bytes at most, where it has the default: rows may hold whole texts, or sets of them.
BATCH_BYTES = str(16 << 20)
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once an application, so that it needn't be installed there."""
    sc = spark.sparkContext
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)
    if spark.conf.get(_BYTES).rstrip("bB") == "67108864":
        spark.conf.set(_BYTES, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="tempolith-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("tempolith", os.path.relpath(full, root)))
    sc.addPyFile(path)  # executors fetch it from the driver until the application ends
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    _shipped.add(sc.applicationId)
