"""Retrieval of graph context for a question: anchors, expansion, context text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranked(lists: list[DataFrame], name: str, kind: str, score: str, source: str, k: int) -> DataFrame:
    """k best of several ranked lists; entries of equal name and first 80 characters of kind count once."""
    u = lists[0]
    for x in lists[1:]:
        u = u.unionByName(x)
    w = Window.partitionBy(name, F.substring(kind, 1, 80)).orderBy(F.desc(score), source)
    return u.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(F.desc(score), name, kind).limit(k)


def anchors(vectors: DataFrame, key: str, vector: str, question: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """The k entities nearest to a question's vector: cosine, dot or l2 (nearest first)."""
    from ..functions import arrays

    q = F.array(*[F.lit(float(x)) for x in question])
    score = {"cosine": arrays.cosine, "dot": arrays.dot, "l2": lambda a, b: -arrays.l2_distance(a, b)}[metric](F.col(vector), q)
    return vectors.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def context_text(hits: DataFrame, question: str, group: str, order: list[str], line) -> DataFrame:
    """One text of all hits' lines, in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    return hits.groupBy(group).agg(F.concat(F.lit(f"Question: {question}\n"), F.array_join(lines, "\n")).alias("context"))
