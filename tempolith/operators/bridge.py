"""Bridges from items of a design to golden entities: candidate search, scores, context, neighbourhood, thresholds.

Candidates of an item come from the text index: its ten best entities by BM25 among those of the types that its kind may
match. Type and token are one term of the index, so types are chosen before the ten are. Then names and descriptions are
compared, names that are equal, part of each other by words or by letters raise the score to a floor, context and the
neighbourhood of the item's parent shift it, and the best entity counts if it reaches the threshold of the item's kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzers import delimiter, text_tokens
from . import resolve, search
from . import similarity as sim

Keep = Callable[[DataFrame, str], DataFrame]
#: Least scores: of parts of an architecture, of modules, and of all others.
THRESHOLDS = {"architecture": 0.5, "module": 0.7}
OTHERS = 0.6
CANDIDATES = 10


def _typed(kind: Column, text: Column) -> Column:
    return F.array_join(F.transform(text_tokens(text), lambda t: F.concat(F.md5(kind), t)), " ")


def candidates(items: DataFrame, entities: DataFrame, compatible: DataFrame, path: str, keep: Keep, most: int = CANDIDATES) -> DataFrame:
    """(item, key): the ``most`` best ``entities`` (key, name, description, type) of each of ``items`` (item, kind, label,
    expanded) by their words; ``compatible`` (kind, type) says which types a kind may match."""
    d = entities.select("key", _typed(F.col("type"), F.concat_ws(" ", "name", "description")).alias("text"))
    index = search.build(d, "key", "text", path, analyzer=lambda t: F.filter(delimiter(" ")(t), lambda x: F.length(x) > 0))
    q = items.join(compatible, "kind").select("item", _typed(F.col("type"), F.concat_ws(" ", "label", "expanded")).alias("text"))
    found, _ = search.top_k(index, search.terms(index, q, "item", "text"), most, keep, digits=7)
    return found.select(F.col("query").alias("item"), "key")


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` (label, expanded, said, context, name, description, near, known) with ``score``.

    ``said`` is what is known of an item in words, ``near`` whether the entity is in the neighbourhood of the item's
    parent, and ``known`` whether the item has one.
    """
    words = lambda c: F.split(F.col(c), " ")
    within = lambda a, b: (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    terms = ("label", "expanded")
    some = lambda test: F.coalesce(test("label"), F.lit(False)) | F.coalesce(test("expanded") & (F.length("expanded") > 0), F.lit(False))
    longest = F.when(F.length(F.coalesce(F.col(terms[1]), F.lit(""))) > F.length(terms[0]), F.col(terms[1])).otherwise(F.col(terms[0]))
    base = sim.weighted_fields(sim.jaro_winkler(longest, F.col("name")), sim.jaro_winkler(F.col("said"), F.coalesce("description", "name")))
    floor = F.when(some(lambda t: F.col(t) == F.col("name")), 0.95).when(some(lambda t: within(words(t), words("name"))), 0.85)
    floor = floor.when(some(lambda t: F.contains("name", F.col(t)) | F.contains(F.col(t), F.col("name"))), 0.80).otherwise(0.0)
    s = F.greatest(base, floor)
    s = F.when(F.length(F.coalesce("context", F.lit(""))) > 0, resolve.with_context(s, sim.token_overlap(F.col("context"), F.col("description")))).otherwise(s)
    return pairs.withColumn("score", F.when(F.col("known"), resolve.graph_boost(s, F.col("near"))).otherwise(s))


def bridge(items: DataFrame, entities: DataFrame, compatible: DataFrame, neighbours: DataFrame, path: str, keep: Keep) -> DataFrame:
    """(item, key, score, margin): the entity that each of ``items`` (item, kind, label, expanded, said, context) resolves to.

    ``neighbours`` (item, key) are entities in the neighbourhood of an item's parent. Names are compared as they stand.
    """
    c = candidates(items, entities, compatible, path, keep)
    known = neighbours.select("item").distinct().withColumn("known", F.lit(True))
    p = c.join(items, "item").join(entities.select("key", "name", "description"), "key").join(known, "item", "left")
    p = p.join(neighbours.select("item", "key").distinct().withColumn("near", F.lit(True)), ["item", "key"], "left").fillna(False, ["near", "known"])
    best = resolve.best_match(scored(p), "item", "score", ["key"], 0.0)
    least = F.lit(OTHERS)
    for kind, t in THRESHOLDS.items():
        least = F.when(F.col("kind") == kind, t).otherwise(least)
    return best.filter(F.col("score") >= least).select("item", "key", "score", "margin")
