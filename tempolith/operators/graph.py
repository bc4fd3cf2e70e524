"""Graph traversal over edge tables: hops, paths, reachability, shortest paths, cycles, ranks, communities.

Edges are (src, dst, ...). Traversals are frontier loops of equi-joins: a level joins the last one's ends to the
edges, so work follows what is reached, and each level is cut from its lineage when it is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def _plain(df: DataFrame, name: str) -> DataFrame:
    return df


def orient(edges: DataFrame, direction: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges as (src, dst) in the direction to walk: outbound, inbound or any."""
    out = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *[c for c in edges.columns if c not in (src, dst)])
    back = edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"), *[c for c in edges.columns if c not in (src, dst)])
    return {"outbound": out, "inbound": back, "any": out.unionByName(back)}[direction]


def hop(start: DataFrame, edges: DataFrame, direction: str = "outbound", types: list[str] | None = None) -> DataFrame:
    """(node, neighbour, ...edge columns): one step from ``start`` (node)."""
    e = orient(edges, direction)
    if types is not None:
        e = e.filter(F.col("type").isin(types))
    return start.select("node").join(e.withColumnRenamed("src", "node"), "node").withColumnRenamed("dst", "neighbour")


def traverse(
    start: DataFrame, edges: DataFrame, low: int, high: int, direction: str = "outbound", unique: str = "path",
    prune: Callable[[Column], Column] | None = None, edge_filter: dict[int, Column] | None = None, keep: Keep = _plain,
) -> DataFrame:
    """Walks of low..high edges from ``start`` (node): (start, node, depth, path).

    ``unique``: "path" lets no vertex repeat on a path, "global" visits each vertex of a start once, at its least
    depth, "none" lets all repeat. ``prune`` (of the end vertex) stops a walk after its vertex is emitted.
    ``edge_filter`` gives, by level from 0, a condition on the edge columns of that level.
    """
    e = orient(edges, direction)
    level = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    out = level if low == 0 else None
    seen = level.select("start", "node")
    for depth in range(1, high + 1):
        step = e.filter(edge_filter[depth - 1]) if edge_filter and depth - 1 in edge_filter else e
        live = level if prune is None else level.filter(~prune(F.col("node")) | (F.col("depth") == 0))
        nxt = live.join(step.select(F.col("src").alias("node"), F.col("dst").alias("_next")), "node")
        if unique == "path":
            nxt = nxt.filter(~F.array_contains("path", F.col("_next")))
        nxt = nxt.select("start", F.col("_next").alias("node"), F.lit(depth).alias("depth"), F.array_append("path", F.col("_next")).alias("path"))
        if unique == "global":
            nxt = nxt.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti")
        level = keep(nxt, f"level-{depth}")
        if unique == "global":
            seen = seen.unionByName(level.select("start", "node"))
        if depth >= low:
            out = level if out is None else out.unionByName(level)
    return out


def typed_chain(start: DataFrame, hops: list[tuple[DataFrame, str, str, Column | None]]) -> DataFrame:
    """A path of given edge tables: (node, n1, n2, ...). Each hop's filter is applied before its join."""
    d = start.select("node")
    at = "node"
    for i, (e, src, dst, cond) in enumerate(hops, 1):
        e = e if cond is None else e.filter(cond)
        d = d.join(e.select(F.col(src).alias(at), F.col(dst).alias(f"n{i}")), at)
        at = f"n{i}"
    return d


def reachable(start: DataFrame, edges: DataFrame, high: int, direction: str = "outbound", keep: Keep = _plain) -> DataFrame:
    """(start, node, depth): least number of steps, start itself left out."""
    return traverse(start, edges, 1, high, direction, "global", keep=keep).select("start", "node", "depth").filter("start <> node")


def cycles(edges: DataFrame, low: int, high: int, keep: Keep = _plain) -> DataFrame:
    """Simple cycles of low..high edges, each once, from its smallest vertex: (node, length, path)."""
    e = edges.select("src", "dst")
    level = e.filter("src < dst OR src = dst").select(F.col("src").alias("node"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"), F.lit(1).alias("length"))
    found = level.filter("node = end").select("node", "length", F.array("node", "node").alias("path")) if low <= 1 else None
    level = level.filter("node <> end")
    for n in range(2, high + 1):
        nxt = level.join(e.select(F.col("src").alias("end"), F.col("dst").alias("_n")), "end").filter("_n >= node")
        closed = nxt.filter("_n = node").select("node", F.lit(n).alias("length"), F.array_append("path", F.col("_n")).alias("path"))
        if n >= low:
            found = closed if found is None else found.unionByName(closed)
        if n < high:
            level = nxt.filter(~F.array_contains("path", F.col("_n"))).select("node", F.col("_n").alias("end"), F.array_append("path", F.col("_n")).alias("path"), F.lit(n).alias("length"))
            level = keep(level, f"cycle-{n}")
    return found


def depth_of(edges: DataFrame, high: int, keep: Keep) -> DataFrame:
    """(node, depth): edges of the longest path down from each vertex; leaves have 0. Beyond ``high``, as on a cycle, it raises."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    depth = keep(nodes.withColumn("depth", F.lit(0)), "depth")
    for _ in range(high):
        below = edges.join(depth.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("depth") + 1).alias("_d"))
        new = keep(depth.join(below, "node", "left").select("node", F.coalesce("_d", F.lit(0)).alias("depth"), F.col("depth").alias("old")), "depth")
        if not new.filter("depth <> old").limit(1).count():
            return new.select("node", "depth")
        depth = new.select("node", "depth")
    raise RuntimeError(f"depths didn't settle in {high} rounds: the graph has a cycle, or longer paths")


def shortest_path(edges: DataFrame, source, target, direction: str = "outbound", weight: str | None = None, high: int = 10_000, keep: Keep = _plain) -> DataFrame:
    """One path of least edges or weight, the least by its vertices among equals: (path, length or cost). None: no row.
    A search that isn't over after ``high`` steps raises."""
    e = orient(edges, direction)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = e.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w"))
    spark = edges.sparkSession
    best = spark.range(1).select(F.lit(source).alias("node"), F.lit(0.0).alias("cost"), F.array(F.lit(source)).alias("path"), F.lit(True).alias("fresh"))
    for i in range(high):
        step = best.filter("fresh").join(e.withColumnRenamed("src", "node"), "node")
        step = step.filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.array_append("path", F.col("dst")).alias("path"), F.lit(True).alias("new"))
        both = best.select("node", "cost", "path", F.lit(False).alias("new")).unionByName(step)
        # of equal cost and path the old one counts, which ends the loop
        best = both.groupBy("node").agg(F.min(F.struct("cost", "path", "new")).alias("_b")).select("node", "_b.cost", "_b.path", F.col("_b.new").alias("fresh"))
        best = keep(best, f"paths-{i}")
        end = best.filter(F.col("node") == target).select("cost").first()
        live = best.filter("fresh") if end is None else best.filter(F.col("fresh") & (F.col("cost") < end["cost"]))
        if not live.limit(1).count():
            return best.filter(F.col("node") == target).select("path", "cost")
    raise RuntimeError(f"no shortest path was certain after {high} steps")


#: Edges that a task has at a time where they are told apart, about.
EDGES = 1_000_000


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each (src, dst) once, in so many partitions by both ends that a task's memory doesn't grow with the table."""
    n = max(1, -(-edges.count() // EDGES))
    e = edges.select("src", "dst")
    return e.repartition(max(n, e.sparkSession.sparkContext.defaultParallelism), "src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree) in one shuffle over the endpoints, which one pass over the edges gives."""
    end = lambda c, o, i: F.struct(F.col(c).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edges.select(F.inline(F.array(end("src", 1, 0), end("dst", 0, 1))))
    g = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return g.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def pagerank(edges: DataFrame, rounds: int, damping: float, keep: Keep) -> DataFrame:
    """(node, rank), ranks add up to 1; vertices without out-edges give theirs to all."""
    e = keep(edges.select("src", "dst").distinct(), "edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    n = nodes.count()
    r = keep(nodes.join(out, "node", "left").select("node", "out", F.lit(1.0 / n).alias("rank")), "rank")
    for _ in range(rounds):
        lost = r.filter("out IS NULL").agg(F.sum("rank")).first()[0] or 0.0
        got = e.join(r, e.src == r.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = r.select("node", "out").join(got, F.col("node") == F.col("dst"), "left")
        r = keep(new.select("node", "out", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank")), "rank")
    return r.select("node", "rank")


def label_propagation(edges: DataFrame, rounds: int, keep: Keep) -> DataFrame:
    """(node, community): all vertices at once take their neighbours' most frequent label, the smallest among equals."""
    e = keep(orient(edges.select("src", "dst"), "any").filter("src <> dst").distinct(), "edges")
    labels = keep(e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    for _ in range(rounds):
        votes = e.join(labels, e.dst == labels.node).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("v"), "community")).alias("_b")).select(F.col("src").alias("node"), F.col("_b.community").alias("new"))
        new = keep(labels.join(best, "node").select("node", F.col("new").alias("community"), F.col("community").alias("old")), "labels")
        changed = new.filter("community <> old").limit(1).count()
        labels = new.select("node", "community")
        if not changed:
            break
    return labels


def strong_components(edges: DataFrame, keep: Keep) -> DataFrame:
    """(node, component): the smallest vertex that a vertex reaches and is reached from, by forward and backward colouring.

    A vertex's colours are the first vertex, in a hashed order, that reaches it, and the first that it reaches
    within that colour. Where both are the same, all vertices of these colours are one component. Edges between
    different colours go, as no component has any, and the rest is coloured again until nothing is left. A step
    takes a vertex's colour on to its colour's colour, so that rings and chains of n vertices by themselves end after
    about log n steps and rounds, in whatever order their ids are; a ring that has its own colour already is walked
    edge by edge when an earlier one enters it from outside.
    """
    kept = keep
    e = kept(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    left = kept(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    done = left.select("node", F.col("node").alias("c")).limit(0)
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    def spread(e: DataFrame) -> DataFrame:
        c = left.withColumn("c", F.col("node"))
        while True:  # places only fall, so this ends
            near = e.join(c.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(place("c"))["v"].alias("n"))
            new = c.join(near, "node", "left").select("node", F.col("c").alias("old"), F.least(place("c"), F.when(F.col("n").isNotNull(), place("n")))["v"].alias("c"))
            jump = c.select(F.col("node").alias("at"), F.col("c").alias("next"))
            new = kept(new.join(jump, new.c == jump["at"]).select("node", "old", F.least(place("c"), place("next"))["v"].alias("c")), "colour")
            c = new.select("node", "c")
            if not new.filter("old <> c").limit(1).count():
                return c

    def within(e: DataFrame, colours: DataFrame) -> DataFrame:
        ends = e.join(colours.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst")
        return kept(ends.filter("a = b").select("src", "dst"), "edges")

    while left.limit(1).count():  # each round ends the first vertex's component at least
        forward = spread(e)
        e = within(e, forward)
        backward = spread(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = kept(forward.join(backward.withColumnRenamed("c", "d"), "node"), "colours")
        done = done.unionByName(both.filter("c = d").select("node", "c"))
        rest = both.filter("c <> d")
        e = within(e, rest.select("node", F.col("d").alias("c")))
        left = kept(rest.select("node"), "nodes")
    least = done.groupBy("c").agg(F.min("node").alias("component"))
    return done.join(least, "c").select("node", "component")


def betweenness(edges: DataFrame, keep: Keep, error: float | None = None, doubt: float = 0.05) -> DataFrame:
    """(node, score): how many shortest paths between other vertices pass through each, each pair's paths counting as one.

    Without ``error`` all vertices are sources and scores are exact. With it, so many hashed sources are taken that each
    score divided by n (n - 1) is within ``error`` of the exact one with a probability of 1 - ``doubt`` for all
    vertices together (by Hoeffding's bound on the share of a source's paths that a vertex can have), or all of them, if
    these are fewer. All sources are searched at once, level by level, until none reaches anything new.
    """
    e = keep(edges.select("src", "dst").distinct(), "edges")
    nodes = keep(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    n = nodes.count()
    some = n if error is None else min(n, math.ceil(math.log(2 * max(n, 1) / doubt) / (2 * error**2)))
    sources = nodes if some == n else nodes.orderBy(F.xxhash64("node"), "node").limit(some)
    level = keep(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")), "level")
    levels, seen = [level], level.select("s", "node")
    while True:
        nxt = levels[-1].join(e.withColumnRenamed("src", "node"), "node").groupBy("s", "dst").agg(F.sum("paths").alias("paths"))
        nxt = keep(nxt.withColumnRenamed("dst", "node").join(seen, ["s", "node"], "left_anti").select("s", "node", "paths"), "level")
        if not nxt.limit(1).count():
            break
        levels.append(nxt)
        seen = keep(seen.unionByName(nxt.select("s", "node")), "seen")
    delta, parts = None, []
    for below, at in zip(reversed(levels[1:]), reversed(levels[:-1])):
        b = below.withColumn("dep", F.lit(0.0)) if delta is None else below.join(delta, ["s", "node"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
        j = at.select("s", F.col("node").alias("src"), F.col("paths").alias("up")).join(e, "src").join(b.select("s", F.col("node").alias("dst"), "paths", "dep"), ["s", "dst"])
        delta = keep(j.groupBy("s", F.col("src").alias("node")).agg(F.sum(F.col("up") / F.col("paths") * (1 + F.col("dep"))).alias("dep")), "dep")
        parts.append(delta.filter("s <> node"))
    out = nodes.select("node", F.lit(0.0).alias("dep"))
    for p in parts:
        out = out.unionByName(p.select("node", "dep"))
    return out.groupBy("node").agg((F.sum("dep") * F.lit(n / max(some, 1))).alias("score"))
