"""Entity resolution: elect, fuzzy pairs, clusters, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import names
from . import similarity as sim


def elect(entities: DataFrame, kind: str, name: str, key: str, description: str) -> DataFrame:
    """One golden entity for each (kind, name in small letters): the longest name, then the smallest key, leads."""
    norm = F.lower(F.trim(F.col(name)))
    best = F.min(F.struct((-F.length(name)).alias("l"), F.col(key).alias("k"), F.col(name).alias("n")))
    g = entities.groupBy(kind, norm.alias("norm")).agg(
        best.alias("_b"), F.count("*").alias("members"), F.array_sort(F.collect_set(name)).alias("aliases"),
        F.array_join(F.array_sort(F.collect_set(description)), " | ").alias("description"),
    )
    return g.select(kind, "norm", F.col("_b.k").alias("primary_key"), F.col("_b.n").alias("name"), "members", "aliases", "description")


def golden(entities: DataFrame, key: str, name: str, seq: str, description: str, version: str, extra: str) -> DataFrame:
    """Order-sensitive merge: first description that isn't empty, union of ``extra`` in order, first and last version."""
    has = F.when(F.length(F.coalesce(description, F.lit(""))) > 0, F.struct(F.col(seq).alias("s"), F.col(description).alias("v")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(extra).alias("v")))), lambda x: x["v"])
    return entities.groupBy(F.lower(F.trim(F.col(name))).alias("norm")).agg(
        F.min(has)["v"].alias("description"), F.array_distinct(ordered).alias("sources"), F.min(version).alias("first_seen"),
        F.max(version).alias("last_seen"), F.count("*").alias("members"), F.min(F.struct(F.col(seq).alias("s"), F.col(key).alias("v")))["v"].alias("primary_key"),
    )


def repoint(edges: DataFrame, mapping: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    """Edges moved from raw to golden endpoints; equal ones merge, with a count. Loops go."""
    m = lambda c, out: mapping.select(F.col("raw").alias(c), F.col("golden").alias(out))
    e = edges.join(m(src, "_s"), src, "left").join(m(dst, "_t"), dst, "left")
    e = e.select(F.coalesce("_s", src).alias(src), F.coalesce("_t", dst).alias(dst), kind)
    return e.filter(F.col(src) != F.col(dst)).groupBy(src, dst, kind).agg(F.count("*").alias("evidence"))


def fuzzy_blocks(entities: DataFrame, block: str, name: str, key: str, distance: int) -> DataFrame:
    """Pairs of entities of a block whose different names are within an edit distance: (block, a, b, ka, kb, distance)."""
    pairs = names.near(entities, block, name, distance)
    keys = entities.select(F.col(block).alias("block"), F.col(name).alias("_n"), F.col(key).alias("_k"))
    side = lambda n, k: keys.select(F.col("block").alias(f"_{k}"), F.col("_n").alias(f"_{n}"), F.col("_k").alias(k))
    j = pairs.join(side("x", "kx"), F.col("block").eqNullSafe(F.col("_kx")) & (F.col("a") == F.col("_x"))).join(side("y", "ky"), F.col("block").eqNullSafe(F.col("_ky")) & (F.col("b") == F.col("_y")))
    swap = F.col("kx") > F.col("ky")
    return j.select(
        F.col("block").alias(block), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.least("kx", "ky").alias("ka"), F.greatest("kx", "ky").alias("kb"), "distance",
    )


def fuzzy_pairs(entities: DataFrame, block: str, name: str, key: str, distance: int = 1, confidence: float = 0.75) -> DataFrame:
    """Fuzzy pairs that are confident enough."""
    p = fuzzy_blocks(entities, block, name, key, distance)
    return p.withColumn("confidence", sim.fuzzy_confidence(F.lower("a"), F.lower("b"))).filter(F.col("confidence") >= confidence)


def cluster_primary(members: DataFrame, component: str, name: str) -> DataFrame:
    """The name of each cluster: the longest, then the greatest."""
    return members.groupBy(component).agg(F.max(F.struct(F.length(name).alias("l"), F.col(name).alias("n"))).alias("_b"), F.count("*").alias("members"), F.array_sort(F.collect_set(name)).alias("aliases")).select(component, F.col("_b.n").alias("name"), "members", "aliases")


def best_match(candidates: DataFrame, item: str, score: str, ties: list[str], threshold: float) -> DataFrame:
    """The best candidate of each item at or above a threshold, with its margin over the second best."""
    w = Window.partitionBy(item).orderBy(F.desc(score), *ties)
    d = candidates.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return d.filter(F.col("_r") == 1).filter(F.col(score) >= threshold).withColumn("margin", F.col(score) - F.coalesce("_next", F.lit(0.0))).drop("_r", "_next")


def bridge_score(name_score: Column, exact: Column, starts: Column, contains: Column) -> Column:
    """Similarity raised to a floor by how names match: fixed steps .95, .85 and .80."""
    return F.greatest(name_score, F.when(exact, 0.95).when(starts, 0.85).when(contains, 0.80).otherwise(0.0))


def with_context(score: Column, context_overlap: Column) -> Column:
    """70 % similarity and 30 % context where there is any, else a tenth less."""
    return F.when(context_overlap > 0, 0.7 * score + 0.3 * context_overlap).otherwise(0.9 * score)


def graph_boost(score: Column, in_neighbourhood: Column, cap: bool = True) -> Column:
    s = F.when(in_neighbourhood, score * 1.2).otherwise(score * 0.95)
    return F.least(s, F.lit(1.0)) if cap else s


def embedding_gate(score: Column, margin: Column, lexical: Column, least: float) -> Column:
    """A match by vectors counts with shared words, or if it is clearly good and clearly the best."""
    return (score >= least) & ((lexical > 0) | ((score >= F.greatest(F.lit(least + 0.08), F.lit(0.80))) & (margin >= 0.05)))
