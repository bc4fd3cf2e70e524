"""Shortest paths between two vertices: all of the fewest edges, and the k cheapest simple ones.

All shortest paths come from the levels of a breadth-first search: edges from one level to the next make a graph
without cycles, which is walked back from the target, so that only vertices on some shortest path are left, and only
then paths are written out.

The k cheapest simple paths are found by deviations. A path's rest from any of its vertices may be replaced by the best
other one that avoids the vertices before it; all these searches of all paths that are looked at together run as one
frontier loop, each led by the exact distance to the target, which no detour can beat. What the driver holds is a row
for each deviation: k paths of so many vertices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import orient

Keep = Callable[[DataFrame, str], DataFrame]
#: Costs that differ by less, of their size, are taken for equal when searches are cut off.
SLACK = 1e-9


def _edges(edges: DataFrame, direction: str, weight: str | None, keep: Keep) -> DataFrame:
    e = orient(edges, direction)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = keep(e.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    if weight and e.filter("w IS NULL OR w <= 0").limit(1).count():
        raise ValueError("weights must be positive")
    return e


def distances(edges: DataFrame, target, keep: Keep) -> DataFrame:
    """(node, left): least cost from each vertex to ``target`` over edges (src, dst, w), until nothing changes."""
    node = edges.schema["dst"].dataType
    best = edges.sparkSession.range(1).select(F.lit(target).cast(node).alias("node"), F.lit(0.0).alias("left"), F.lit(True).alias("fresh"))
    while True:
        step = best.filter("fresh").join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), (F.col("left") + F.col("w")).alias("left"), F.lit(True).alias("new"))
        both = best.select("node", "left", F.lit(False).alias("new")).unionByName(step)
        best = keep(both.groupBy("node").agg(F.min(F.struct("left", "new")).alias("b")).select("node", "b.left", F.col("b.new").alias("fresh")), "distances")
        if not best.filter("fresh").limit(1).count():
            return best.select("node", "left")


def all_shortest_paths(edges: DataFrame, source, target, direction: str = "outbound", keep: Keep = lambda d, n: d) -> DataFrame:
    """(path, length): every path of fewest edges from ``source`` to ``target``; no row if there is none."""
    e = _edges(edges, direction, None, keep).select("src", "dst")
    node = e.schema["src"].dataType
    first = e.sparkSession.range(1).select(F.lit(source).cast(node).alias("node"))
    if source == target:
        return first.select(F.array("node").alias("path"), F.lit(0).alias("length"))
    levels, seen, at = [], first, first
    while True:
        step = keep(at.join(e, F.col("node") == F.col("src")).select("src", "dst").join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti"), "step")
        at = keep(step.select(F.col("dst").alias("node")).distinct(), "level")
        levels.append(step)
        if at.filter(F.col("node") == F.lit(target)).limit(1).count():
            break
        if not at.limit(1).count():
            return first.select(F.array("node").alias("path"), F.lit(0).alias("length")).limit(0)
        seen = keep(seen.unionByName(at), "seen")
    on = first.select(F.lit(target).cast(node).alias("dst"))
    used = []
    for step in reversed(levels):
        used.append(keep(step.join(on, "dst"), "used"))
        on = used[-1].select(F.col("src").alias("dst")).distinct()
    paths = first.select("node", F.array("node").alias("path"))
    for step in reversed(used):
        paths = paths.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        paths = keep(paths, "paths")
    return paths.select("path", F.lit(len(levels)).alias("length"))


def shortest_path_counts(edges: DataFrame, source, direction: str = "outbound", keep: Keep = lambda d, n: d) -> DataFrame:
    """(node, distance, paths): how many paths of fewest edges lead from ``source`` to each vertex it reaches."""
    e = _edges(edges, direction, None, keep).select("src", "dst")
    number = "decimal(38,0)"
    at = e.sparkSession.range(1).select(F.lit(source).cast(e.schema["src"].dataType).alias("node"), F.lit(0).alias("distance"), F.lit(1).cast(number).alias("paths"))
    seen = at
    while True:
        step = at.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("paths").cast(number).alias("paths"), (F.max("distance") + 1).alias("distance"))
        at = keep(step.join(seen.select("node"), "node", "left_anti").select("node", "distance", "paths"), "level")
        if not at.limit(1).count():
            return seen
        seen = keep(seen.unionByName(at), "seen")


def _deviations(e: DataFrame, roots: list, target, limit: float, keep: Keep) -> list:
    """(path, costs) of the best way to ``target`` of each root (path, costs, vertices that may not come next).

    ``e`` has (src, dst, w, left), with the distance from dst to the target. A search extends those of its open
    labels that may be on its best path; a vertex has one label in a search, the cheapest, least by its vertices.
    """
    vertex = e.schema["src"].dataType.simpleString()
    schema = f"search int, node {vertex}, path array<{vertex}>, costs array<double>, banned array<{vertex}>"
    start = e.sparkSession.createDataFrame([(i, p[-1], list(p), list(c), sorted(b)) for i, (p, c, b) in enumerate(roots)], schema)

    def extended(labels: DataFrame) -> DataFrame:
        j = labels.join(e, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst")) & ~F.array_contains("banned", F.col("dst")))
        cost = F.element_at("costs", -1) + F.col("w")
        j = j.select("search", F.col("dst").alias("node"), cost.alias("cost"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("costs", cost).alias("costs"), F.lit(True).alias("open"), (cost + F.col("left")).alias("f"))
        return j.filter(F.col("f") <= limit * (1 + SLACK)) if limit < float("inf") else j

    labels = None
    new = extended(start)
    while True:
        both = new if labels is None else labels.unionByName(new)
        best = F.min(F.struct("cost", "path", "open", "costs", "f"))  # an equal label that is closed stays so
        labels = keep(both.groupBy("search", "node").agg(best.alias("b")).select("search", "node", "b.cost", "b.path", "b.costs", "b.open", "b.f"), "labels")
        open_ = F.when(F.col("open") & (F.col("node") != F.lit(target)), F.col("f"))
        end = F.when(F.col("node") == F.lit(target), F.col("cost"))
        state = labels.groupBy("search").agg(F.min(open_).alias("least"), F.coalesce(F.min(end), F.min(open_)).alias("bound"))
        state = [(r["search"], r["bound"] * (1 + SLACK)) for r in state.collect() if r["least"] is not None and r["least"] <= r["bound"] * (1 + SLACK)]  # a row a search
        if not state:
            break
        bounds = F.broadcast(e.sparkSession.createDataFrame(state, "search int, bound double"))
        marked = labels.join(bounds, "search", "left").withColumn("live", F.coalesce(F.col("open") & (F.col("node") != F.lit(target)) & (F.col("f") <= F.col("bound")), F.lit(False)))
        labels = marked.withColumn("open", F.col("open") & ~F.col("live")).drop("bound", "live")
        new = extended(marked.filter("live").select("search", "node", "path", "costs", F.array().cast(f"array<{vertex}>").alias("banned")))
    return [(tuple(r["path"]), tuple(r["costs"])) for r in labels.filter(F.col("node") == F.lit(target)).select("path", "costs").collect()]  # a row a search at most


def k_shortest_paths(edges: DataFrame, source, target, k: int, direction: str = "outbound", weight: str | None = None, keep: Keep = lambda d, n: d) -> DataFrame:
    """(rank, path, cost): the ``k`` simple paths of least cost, ties by their vertices; fewer if there are fewer."""
    plain = _edges(edges, direction, weight, keep)
    spark, vertex = plain.sparkSession, plain.schema["src"].dataType.simpleString()
    left = distances(plain, target, keep)
    e = keep(plain.join(left.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "w", "left"), "guided")
    found = {(source,): (0.0,)} if source == target else dict(_deviations(e, [((source,), (0.0,), ())], target, float("inf"), keep))
    expanded: set = set()
    while source != target:
        best = sorted(found, key=lambda p: (found[p][-1], p))[:k]
        # what deviates from the last of k paths comes after it
        todo = [p for p in (best[:-1] if len(best) == k else best) if p not in expanded]
        if not todo:
            break
        expanded.update(todo)
        roots = {p[: i + 1]: found[p][: i + 1] for p in todo for i in range(len(p) - 1)}
        banned: dict = {r: set() for r in roots}
        for p in expanded:
            for i in range(len(p) - 1):
                if p[: i + 1] in banned:
                    banned[p[: i + 1]].add(p[i + 1])
        limit = found[best[-1]][-1] if len(best) == k else float("inf")
        found.update(_deviations(e, [(r, c, banned[r]) for r, c in roots.items()], target, limit, keep))
    best = sorted(found, key=lambda p: (found[p][-1], p))[:k]
    return spark.createDataFrame([(i + 1, list(p), found[p][-1]) for i, p in enumerate(best)], f"rank int, path array<{vertex}>, cost double")
