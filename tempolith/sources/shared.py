"""The folder that driver and executors share, and scratch tables in it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as set for the session; one is made only where it is unset, in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    d = os.path.join(tempfile.gettempdir(), f"tempolith-{os.getpid()}")
    if not os.path.isdir(d):
        os.makedirs(d)
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    return f"file://{os.path.abspath(d)}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends or ``release`` is called."""
    path = f"{shared_dir(spark)}/tempolith/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


#: Rows up to which a table of a loop may be joined by broadcast.
FEW = 10_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there from now on.

    A written table has the size it has, where a checkpoint keeps the estimate of its lineage, which a loop of joins
    multiplies at every step; so small tables of a loop are joined by broadcast. Larger ones never are, however small
    their files: a loop would send them through the driver at every step, so that what passes there would grow with
    the table and with the steps.
    """
    path, rows = scratch(df.sparkSession, "kept"), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return kept if rows.get.get("n", 0) <= FEW else kept.hint("merge")


def release(since: int = 0) -> None:
    """Delete scratch made after the first ``since`` paths; only when no frame that reads it is needed any more."""
    while len(_made) > since:
        spark, path = _made.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is the cluster's scratch space
            pass


def scratch_mark() -> int:
    return len(_made)


atexit.register(release)
