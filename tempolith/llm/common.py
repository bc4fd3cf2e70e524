"""What the corpus operators share: scratch tables, ordered partitions, word patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import release, scratch, scratch_mark

__all__ = ["LEAST", "WORD", "chunks", "give_back", "lean", "neutral", "partitions", "range_bounds", "range_of", "release", "scratch", "scratch_mark", "word_count", "written"]

#: The least long; no range bound is so small.
LEAST = -(2**63)
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as long; null counts 0. One pass of the regex engine, no array is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- scratch in the shared folder -------------------------------------------------------------


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- partitions in the order of a key -----------------------------------------------------------


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending integer bounds that split the rows of ``key`` into near equal ranges."""
    if n < 2:
        return []
    q = df.select(F.col(key).cast("double").alias(key)).approxQuantile(key, [i / n for i in range(1, n)], 1 / (8 * n))
    return sorted({min(max(int(np.ceil(x)), LEAST + 1), -LEAST - 1) for x in q})


def range_of(key: Column, bounds: list[int]) -> Column:
    """Index of the range of ``key``: the number of bounds at or below it; null goes first, with the least long."""
    b = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def find(x):
        import pandas as pd

        return pd.Series(np.searchsorted(b, x.to_numpy(), side="right").astype("int32"))

    # without nulls pandas keeps longs as they are; with them it would make doubles, which round above 2 ** 53
    return find(F.coalesce(key.cast("long"), F.lit(LEAST))) if bounds else F.lit(0)


# --- tasks over texts in Python ---------------------------------------------------------------------


def chunks(batch, at_once: int = 1_000_000):
    """Slices of an Arrow batch of about ``at_once`` bytes of text, a row at least."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        base = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, base + at_once, side="right")))
        yield batch.slice(a, b - a)
        a = b


def lean(task):
    """``task``, which gives the memory that its batches took back to the system when it ends: workers live on."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Memory that nothing holds any more goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# --- columns under neutral names ------------------------------------------------------------------


def neutral(df: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns but those of ``keep`` under names that nothing else has, and new name by old one."""
    names = {c: c if c in keep else f"_own{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
