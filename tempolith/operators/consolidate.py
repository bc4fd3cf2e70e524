"""Raw entities to golden ones, in two stages, with the edges between them.

The first stage elects one golden entity for each type and name in small letters, draws CONSOLIDATES edges to its raw
ones, and sweeps relations from raw to golden ends. The second merges golden entities of a type whose names are nearly
equal, transitively, under the one of the longest name; aliases are united, descriptions joined, and edges and relations
of the merged ones point to it. Pairs come from the index of deletion neighbourhoods, groups from connected components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resolve
from .components import connected_components

Keep = Callable[[DataFrame, str], DataFrame]


def golden_entities(raw: DataFrame) -> DataFrame:
    """(golden, type, name, description, aliases, members) of ``raw`` (key, type, name, description)."""
    norm = F.lower(F.trim("name"))
    first = F.min(F.struct((-F.length("name")).alias("l"), F.col("key").alias("k"), F.col("name").alias("n")))
    said = F.array_sort(F.collect_set(F.trim("description")))
    g = raw.filter("name IS NOT NULL").groupBy("type", norm.alias("norm")).agg(first["n"].alias("name"), F.array_join(said, " | ").alias("description"), F.collect_set("name").alias("_names"), F.count("*").alias("members"))
    aliases = F.array_sort(F.filter("_names", lambda x: x != F.col("name")))
    return g.select(F.md5(F.concat_ws(":", F.coalesce("type", F.lit("")), "norm")).alias("golden"), "type", "name", "description", aliases.alias("aliases"), "members")


def consolidates(raw: DataFrame) -> DataFrame:
    """(golden, raw): which golden entity each raw one belongs to."""
    return raw.filter("name IS NOT NULL").select(F.md5(F.concat_ws(":", F.coalesce("type", F.lit("")), F.lower(F.trim("name")))).alias("golden"), F.col("key").alias("raw"))


def swept(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, src, dst, type, evidence, provenance) of ``relations`` (relation, src, dst, type) between golden ends.

    A relation counts if one end at least is consolidated; the other one keeps its raw key. Equal ones merge.
    """
    to = lambda end, out: edges.select(F.col("raw").cast("string").alias(end), F.col("golden").alias(out))
    r = relations.select("relation", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "type")
    r = r.join(to("src", "_s"), "src", "left").join(to("dst", "_d"), "dst", "left").filter("_s IS NOT NULL OR _d IS NOT NULL")
    r = r.select("relation", F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "type")
    g = r.groupBy("src", "dst", "type").agg(F.count("*").alias("evidence"), F.array_sort(F.collect_list("relation")).alias("provenance"))
    return g.select(F.md5(F.concat("src", "dst", "type")).alias("key"), "src", "dst", "type", "evidence", "provenance")


def merge_candidates(golden: DataFrame, distance: int = 1, confidence: float = 0.75) -> DataFrame:
    """(type, ka, kb, a, b, distance, confidence): pairs of golden entities that the second stage would merge."""
    g = golden.select("type", F.lower(F.trim("name")).alias("name"), "golden")
    return resolve.fuzzy_pairs(g, "type", "name", "golden", distance, confidence)


def merge_map(golden: DataFrame, candidates: DataFrame, keep: Keep) -> DataFrame:
    """(golden, primary) of all golden entities in a group of more than one: the longest name leads, then the greatest."""
    c = connected_components(candidates, keep, "ka", "kb")
    m = c.join(golden.select(F.col("golden").alias("node"), "name"), "node")
    lead = F.max(F.struct(F.length("name").alias("l"), "name", "node"))
    return m.join(m.groupBy("component").agg(lead["node"].alias("primary")), "component").select(F.col("node").alias("golden"), "primary")


def merged(golden: DataFrame, mapping: DataFrame) -> DataFrame:
    """``golden`` with merged entities in the place of their members, and ``merged``, how many went into each."""
    g = golden.join(mapping, "golden", "left").withColumn("primary", F.coalesce("primary", "golden")).withColumn("_own", F.col("primary") == F.col("golden"))
    lead = lambda c: F.max(F.when(F.col("_own"), F.col(c)))
    said = F.array_sort(F.collect_list(F.when(F.coalesce("description", F.lit("")) != "", F.struct((~F.col("_own")).alias("later"), "name", "golden", "description"))))
    names = F.flatten(F.collect_list(F.array_append("aliases", F.col("name"))))
    out = g.groupBy(F.col("primary").alias("golden")).agg(
        F.first("type").alias("type"), lead("name").alias("name"), F.array_join(F.transform(said, lambda x: x["description"]), " | ").alias("description"),
        F.array_sort(F.array_distinct(names)).alias("_names"), F.sum("members").alias("members"), (F.count("*") - 1).alias("merged"),
    )
    return out.select("golden", "type", "name", "description", F.filter("_names", lambda x: x != F.col("name")).alias("aliases"), "members", "merged")


def repointed(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """CONSOLIDATES edges (golden, raw) from the merged entities."""
    return edges.join(mapping, "golden", "left").select(F.coalesce("primary", "golden").alias("golden"), "raw")


def repointed_relations(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Golden relations between merged entities; those that become equal are one, with all their evidence."""
    to = lambda end, out: mapping.select(F.col("golden").alias(end), F.col("primary").alias(out))
    r = relations.join(to("src", "_s"), "src", "left").join(to("dst", "_d"), "dst", "left").select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "type", "evidence", "provenance")
    g = r.groupBy("src", "dst", "type").agg(F.sum("evidence").alias("evidence"), F.array_sort(F.flatten(F.collect_list("provenance"))).alias("provenance"))
    return g.select(F.md5(F.concat("src", "dst", "type")).alias("key"), "src", "dst", "type", "evidence", "provenance")


def consolidate(raw: DataFrame, relations: DataFrame, keep: Keep, distance: int = 1, confidence: float = 0.75, dry_run: bool = False) -> dict[str, DataFrame]:
    """Both stages: frames "golden", "consolidates", "relations" and "candidates". A dry run stops before merging."""
    golden, edges = keep(golden_entities(raw), "golden"), consolidates(raw)
    rel = swept(relations, edges)
    candidates = keep(merge_candidates(golden, distance, confidence), "candidates")
    if dry_run:
        return {"golden": golden.withColumn("merged", F.lit(0).cast("long")), "consolidates": edges, "relations": rel, "candidates": candidates}
    mapping = keep(merge_map(golden, candidates, keep), "mapping")
    return {"golden": merged(golden, mapping), "consolidates": repointed(edges, mapping), "relations": repointed_relations(rel, mapping), "candidates": candidates}

