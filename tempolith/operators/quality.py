"""Audit and quality figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(df: DataFrame, truth: str, guess: str, digits: int = 6) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) in one pass; figures without a base are null."""
    t, g = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(guess), F.lit(False))
    c = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    r = lambda a, b: F.round(F.try_divide(a, b), digits)
    tp = F.col("tp")
    return c.select("tp", "fp", "fn", r(tp, tp + F.col("fp")).alias("precision"), r(tp, tp + F.col("fn")).alias("recall"), r(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def collection_stats(tables: dict[str, DataFrame], sample: int = 20) -> DataFrame:
    """(collection, n, avg_bytes): counts, and the mean JSON size of a few documents."""
    out = None
    for name, df in tables.items():
        few = df.limit(sample).agg(F.round(F.avg(F.octet_length(F.to_json(F.struct("*")))), 2).alias("avg_bytes"))
        row = df.agg(F.count("*").alias("n")).crossJoin(few).select(F.lit(name).alias("collection"), "n", "avg_bytes")
        out = row if out is None else out.unionByName(row)
    return out


def histogram(df: DataFrame, score: str, width: float = 0.1) -> DataFrame:
    """(bucket, n) by steps of a score."""
    return df.groupBy((F.floor(F.round(F.col(score) / width, 9)) * width).alias("bucket")).agg(F.count("*").alias("n"))
