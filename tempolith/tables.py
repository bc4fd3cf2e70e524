"""Reading the star-schema and corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Sentinel for "still valid" in validity intervals, in epoch seconds.
OPEN_TS = 9999999999


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``; only Spark's reader touches the path, so any file system works."""
    if name not in NAMES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views for SQL."""
    for n in names or NAMES:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def epoch_seconds(col):
    """Seconds since 1970 of a timestamp column, zone-free."""
    return F.unix_micros(F.col(col).cast("timestamp")) / 1_000_000 if isinstance(col, str) else F.unix_micros(col.cast("timestamp")) / 1_000_000


def rounded_seconds(col):
    """Whole seconds since 1970 of a timestamp column, to the nearest; halves go to the even one, as in SQL's cast of epoch()."""
    return F.rint(epoch_seconds(col)).cast("long")
