"""Names within an edit distance, by an index of their deletion neighbourhoods.

Two names within d edits have a common rest after at most d deletions from each. So every name is indexed under all
rests that are left when up to d of its characters are taken out, names meet where they share one, by an equi-join, and
the distance is computed for these only. The rows of the index grow with the names, those of the join with the names
that are nearly equal, whatever the size of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rests(name: Column, deletions: int) -> Column:
    """All that is left of a name without up to ``deletions`` of its characters, each once."""
    shorter = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
    level = every = F.array(name)
    for _ in range(deletions):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def index(names: DataFrame, block: str, name: str, distance: int) -> DataFrame:
    """(block, name, h): a row for each rest of each distinct name of a block, as a digest."""
    n = names.select(F.col(block).alias("block"), F.col(name).alias("name")).filter("name IS NOT NULL").distinct()
    return n.withColumn("rest", F.explode(rests(F.col("name"), distance))).select("block", "name", F.xxhash64("block", "rest").alias("h"))


def near(names: DataFrame, block: str, name: str, distance: int) -> DataFrame:
    """(block, a, b, distance): pairs a < b of different names of a block within ``distance`` edits."""
    x = index(names, block, name, distance)
    a, b = x.withColumnRenamed("name", "a"), x.select(F.col("block").alias("_block"), F.col("name").alias("b"), F.col("h").alias("_h"))
    met = a.join(b, (F.col("h") == F.col("_h")) & F.col("block").eqNullSafe(F.col("_block")) & (F.col("a") < F.col("b")))
    met = met.filter(F.abs(F.length("a") - F.length("b")) <= distance).select("block", "a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", distance)).filter("distance >= 0")
