"""Walks over several edge collections: directions of their own, unique vertices and edges, orders, weights.

Edges are (edge, src, dst, type, ...), each with an identity, so parallel edges count. A level joins the ends of the
last one's walks to the edges, as in ``graph.traverse``; what must not repeat is carried along the walk. The cheapest
way to every vertex comes from buckets of costs: all vertices whose cost lies in the first bucket are settled together
before the next one is looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def directed(edges: DataFrame, directions: dict[str, str] | str) -> DataFrame:
    """(edge, src, dst, type, ...) in the directions to walk: one for all types, or one for each; other types go."""
    turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    if isinstance(directions, str):
        out, back = F.lit(directions in ("outbound", "any")), F.lit(directions in ("inbound", "any"))
    else:
        of = lambda *ways: F.col("type").isin([t for t, w in directions.items() if w in ways])
        out, back = of("outbound", "any"), of("inbound", "any")
    # a loop is walked once, in whatever direction
    return edges.filter(out).unionByName(turned.filter(back & ((F.col("src") != F.col("dst")) | ~out)))


def walks(
    start: DataFrame, edges: DataFrame, low: int, high: int, directions: dict[str, str] | str = "outbound", unique_vertices: str = "none", unique_edges: str = "path",
    weight: str | None = None, order: str = "bfs", vertices: DataFrame | None = None, edge_filter: Column | None = None, keep: Keep = lambda d, n: d,
) -> DataFrame:
    """Walks of low..high edges from ``start`` (node): (start, node, depth, cost, path, edges), in ``order``.

    ``unique_vertices``: "path" lets no vertex repeat on a walk, "none" lets them; "global" visits each vertex of a start
    once, by its first walk in ``order``. ``unique_edges``: "path" or "none". ``order`` sorts the walks of a start: "bfs"
    by depth, "dfs" each before those that go on from it, "weighted" by cost; ties by their vertices and edges.
    ``vertices`` (node) are the only ones that walks may enter.
    """
    if unique_vertices not in ("none", "path", "global") or unique_edges not in ("none", "path") or order not in ("bfs", "dfs", "weighted"):
        raise ValueError("unknown option of walks")
    if unique_vertices == "global" and order == "dfs":
        raise ValueError("vertices can be globally unique in the orders bfs and weighted")
    e = directed(edges if edge_filter is None else edges.filter(edge_filter), directions)
    e = e.select(F.col("src").alias("node"), F.col("dst").alias("_to"), F.col("edge").alias("_edge"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    if vertices is not None:
        e = e.join(vertices.select(F.col("node").alias("_to")), "_to", "left_semi")
    kind = edges.schema["edge"].dataType.simpleString()
    level = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.lit(0.0).alias("cost"), F.array("node").alias("path"), F.array().cast(f"array<{kind}>").alias("edges"))
    every = level
    for depth in range(1, high + 1):
        nxt = level.join(e, "node")
        if unique_vertices == "path":
            nxt = nxt.filter(~F.array_contains("path", F.col("_to")))
        if unique_edges == "path":
            nxt = nxt.filter(~F.array_contains("edges", F.col("_edge")))
        nxt = nxt.select("start", F.col("_to").alias("node"), F.lit(depth).alias("depth"), (F.col("cost") + F.col("_w")).alias("cost"), F.array_append("path", F.col("_to")).alias("path"), F.array_append("edges", F.col("_edge")).alias("edges"))
        if unique_vertices == "global":
            first = F.min(F.struct("depth", "cost", "path", "edges") if order == "bfs" else F.struct("cost", "depth", "path", "edges")).alias("b")
            nxt = nxt.groupBy("start", "node").agg(first).select("start", "node", "b.depth", "b.cost", "b.path", "b.edges")
            if order == "bfs":
                nxt = nxt.join(every.select("start", "node"), ["start", "node"], "left_anti")
            else:  # only walks that are cheaper than the vertex's best so far go on
                best = every.groupBy("start", "node").agg(F.min("cost").alias("_best"))
                nxt = nxt.join(best, ["start", "node"], "left").filter(F.col("_best").isNull() | (F.col("cost") < F.col("_best"))).drop("_best")
        level = keep(nxt, f"walks-{depth}")
        every = every.unionByName(level)
    if unique_vertices == "global" and order == "weighted":
        every = every.groupBy("start", "node").agg(F.min(F.struct("cost", "depth", "path", "edges")).alias("b")).select("start", "node", "b.depth", "b.cost", "b.path", "b.edges")
    out = every.filter(F.col("depth") >= low)
    return out.orderBy("start", *{"bfs": ["depth", "path", "edges"], "dfs": ["path", "edges"], "weighted": ["cost", "path", "edges"]}[order])


def cheapest(start: DataFrame, edges: DataFrame, weight: str, width: float, keep: Keep, directions: dict[str, str] | str = "outbound") -> DataFrame:
    """(start, node, cost): the least cost to every vertex that a start reaches, by buckets of ``width``.

    In a bucket, vertices whose cost falls into it are walked on from until none of them gets cheaper; only then are
    dearer ones looked at, so few edges are walked more than once. Weights below 0 raise.
    """
    e = keep(directed(edges, directions).select(F.col("src").alias("node"), F.col("dst").alias("_to"), F.col(weight).cast("double").alias("_w")).groupBy("node", "_to").agg(F.min("_w").alias("_w")), "edges")
    if e.filter("_w IS NULL OR _w < 0").limit(1).count():
        raise ValueError("weights must not be negative")
    best = keep(start.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("cost"), F.lit(True).alias("open")).distinct(), "best")
    while True:
        least = best.filter("open").agg(F.min("cost")).first()[0]
        if least is None:
            return best.select("start", "node", "cost")
        end = (least // width + 1) * width
        here = F.col("open") & (F.col("cost") < F.lit(end))
        step = best.filter(here).join(e, "node").select("start", F.col("_to").alias("node"), (F.col("cost") + F.col("_w")).alias("cost"), F.lit(True).alias("open"))
        both = best.withColumn("open", F.col("open") & ~here).unionByName(step)
        # of equal costs the closed one counts
        best = keep(both.groupBy("start", "node").agg(F.min(F.struct("cost", "open")).alias("b")).select("start", "node", "b.cost", "b.open"), "best")


def subgraph(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``nodes`` and ``edges`` of some walks, sorted, as JSON to display."""
    nodes = found.select(F.explode("path").alias("n")).distinct().agg(F.to_json(F.array_sort(F.collect_list("n"))).alias("nodes"))
    used = found.select(F.explode("edges").alias("edge")).distinct().join(edges.select("edge", "src", "dst", "type"), "edge")
    return nodes.crossJoin(used.agg(F.to_json(F.array_sort(F.collect_list(F.struct("edge", "src", "dst", "type")))).alias("edges")))  # one row each
