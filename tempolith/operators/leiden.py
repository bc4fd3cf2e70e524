"""Communities of a weighted undirected graph by the Leiden method.

A level has three steps. Vertices move to the neighbouring community that raises modularity most; those beside a moved
one are looked at again, until none is left. Then communities are refined: within each, every vertex starts by itself and
joins a connected part of the community once. The refined parts become the vertices of the next level's graph, with the
weights between them summed, and start in the communities that their members were in. Levels end when nothing merges any more. At last communities that moves
have cut apart are split into their connected parts, which raises modularity, too; as refined parts are connected, the
last level's graph says where.

All vertices decide at once, but only a hashed half of them moves in a round, so that two neighbours don't swap for ever;
in a refining round, parts that may move aren't joined by others, so parts stay connected. A round sends the state of
each vertex along its edges and meets it once, at the neighbours, where all of a vertex's choices lie together.

A vertex with a single neighbour is in that one's community in any best division, if the resolution is 1 at most, so
these are joined before the first level. Where at most ``FEW`` edges are left to look at, rounds of all vertices are worth
less than one task, in which vertices decide one after another: those that still want to move, those that are still by
themselves in refinement, and all vertices of a level's graph that has no more edges, through all further levels.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

Keep = Callable[[DataFrame, str], DataFrame]
#: Gains below are rounding.
LEAST = 1e-9
#: Edges, counted in both directions, up to which one task has them.
FEW = 100_000


def _half(node: Column, i: int) -> Column:
    """Whether a vertex may move in round ``i``: by the first bit of the MD5 digest of its name and the round's pair."""
    return (F.conv(F.substring(F.md5(F.concat(node.cast("string"), F.lit(f":{i // 2}"))), 1, 1), 16, 10).cast("int") % 2) == i % 2


def _choices(e: DataFrame, state: DataFrame, m2: float, resolution: float, *own: str) -> DataFrame:
    """(node, k, community, stay, new, gain and ``own`` columns): the best community beside each vertex of ``state`` (node, k,
    community, total, open), among those of open vertices, and the gain of moving there; and what staying gains.

    The vertex counts as taken out of its own community. ``e`` has the weights ``k`` of its ``src``.
    """
    other = state.filter("open").select(F.col("node").alias("dst"), "community", "total")
    none = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in own]
    beside = e.join(other, "dst").select(F.col("src").alias("node"), "k", "community", "total", "w", F.lit(False).alias("own"), *none)
    self = state.select("node", "k", "community", "total", F.lit(0.0).alias("w"), F.lit(True).alias("own"), *own)
    most = [F.max(c).alias(c) for c in own]
    rows = beside.unionByName(self).repartition("node").groupBy("node", "community").agg(F.max("k").alias("k"), F.max("total").alias("total"), F.sum("w").alias("into"), F.max("own").alias("own"), *most)
    rest = F.col("total") - F.when(F.col("own"), F.col("k")).otherwise(0.0)
    rows = rows.withColumn("gain", F.round(F.col("into") - resolution * rest * F.col("k") / m2, 9))
    best = F.min(F.when(~F.col("own"), F.struct((-F.col("gain")).alias("g"), "community")))
    mine = lambda c: F.max(F.when(F.col("own"), F.col(c)))
    rows = rows.groupBy("node").agg(F.max("k").alias("k"), mine("community").alias("community"), mine("gain").alias("stay"), best.alias("b"), *most)
    return rows.select("node", "k", "community", "stay", F.col("b.community").alias("new"), (-F.col("b.g")).alias("gain"), *own)


def _settled(e: DataFrame, state: DataFrame, free: DataFrame, m2: float, resolution: float, once: bool) -> DataFrame:
    """(node, to): vertices of ``free`` that have few edges, moved one after another until none of them gains by it; and, with
    null, their neighbours in other communities, who may gain now.

    With ``once``, they are by themselves at first, and each one that joins another, or is joined, stays.
    """
    import pandas as pd

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["src", "dst"])
        near, ks, of = {}, {}, {}
        total = dict(zip(x["own"], x["own_total"])) | dict(zip(x["community"], x["total"]))
        for v, u, w, k, own, c in zip(x["src"], x["dst"], x["w"], x["k"], x["own"], x["community"]):
            near.setdefault(v, []).append((u, w))
            ks[v], of[v], of[u] = k, own, c
        alone = {of[v] for v in ks} if once else None
        todo, waits, beside = deque(sorted(ks)), set(ks), set()
        while todo:
            v = todo.popleft()
            waits.discard(v)
            if alone is not None and of[v] not in alone:
                continue
            c = _best(near[v], of, total, of[v], ks[v], m2, resolution)
            if c is None:
                continue
            total[of[v]] -= ks[v]
            total[c] += ks[v]
            if alone is not None:
                alone -= {of[v], c}
            of[v] = c
            beside.update(u for u, _ in near[v] if u not in ks and of[u] != c)
            more = [u for u, _ in near[v] if u in ks and of[u] != c and u not in waits]
            todo.extend(more)
            waits.update(more)
        beside = [] if once else sorted(beside)
        return pd.DataFrame({"node": [*ks, *beside], "to": pd.Series([*(of[v] for v in ks), *[None] * len(beside)], dtype=kinds[0] if beside else None)})

    mine = state.join(free.select("node"), "node").select(F.col("node").alias("src"), F.col("community").alias("own"), F.col("total").alias("own_total"))
    rows = e.join(mine, "src").join(state.select(F.col("node").alias("dst"), "community", "total"), "dst")
    kind = state.schema["node"].dataType.simpleString()
    kinds = ["Int64" if kind in ("tinyint", "smallint", "int", "bigint") else "object"]
    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, f"node {kind}, to {kind}")


def _best(near: list, of, total, own, k: float, m2: float, resolution: float):  # noqa: ANN001
    """The community beside a vertex that it gains most by moving to; None if staying, or being alone, gains as much."""
    into: dict = {}
    for u, x in near:
        into[of[u]] = into.get(of[u], 0.0) + x
    # a vertex without neighbours in its own community gains nothing there
    stay = max(into.pop(own, 0.0) - resolution * (total[own] - k) * k / m2, 0.0)
    g, c = min(((resolution * total[c] * k / m2 - x, c) for c, x in into.items()), default=(0.0, None))
    return c if -g > stay + LEAST else None


def _moved(e: DataFrame, nodes: DataFrame, m2: float, resolution: float, rounds: int, keep: Keep) -> DataFrame:
    """Vertices moved until none beside a moved one is left to gain by it, or still many are after ``rounds`` rounds of all."""
    i, waiting = 0, None
    while i < rounds:
        state = nodes.withColumn("total", F.sum("k").over(Window.partitionBy("community"))).withColumn("open", F.lit(True))
        if waiting is None:
            # a vertex without neighbours in its own community gains nothing there
            better = F.coalesce(F.col("gain") > F.greatest("stay", F.lit(0.0)) + LEAST, F.lit(False))
            new = keep(_choices(e, state, m2, resolution, "n").select("node", "k", "n", "community", "new", better.alias("better")), "moved")
            ready = new.filter("better")
            n = ready.agg(F.sum("n")).first()[0]
            if not n:
                break
            if n > FEW:
                to = F.when(F.col("better") & _half(F.col("node"), i), F.col("new")).otherwise(F.col("community"))
                nodes = new.select("node", "k", "n", to.alias("community"))
                i += 1
                continue
        else:
            ready = waiting
        to = _settled(e, state, ready, m2, resolution, False).withColumn("_seen", F.lit(True))
        new = nodes.join(to, "node", "left").select("node", "k", "n", F.coalesce("to", "community").alias("community"), F.coalesce(F.col("to") != F.col("community"), F.lit(False)).alias("moved"), (F.col("_seen").isNotNull() & F.col("to").isNull()).alias("waits"))
        new = keep(new, "settled")
        nodes = new.drop("moved", "waits")
        moved, n = new.agg(F.max("moved"), F.sum(F.when(F.col("waits"), F.col("n")))).first()
        if not moved or not n:
            break
        waiting = new.filter("waits") if n <= FEW else None  # if many wait, all are looked at again
    return nodes


def _refined(e: DataFrame, nodes: DataFrame, m2: float, resolution: float, rounds: int, keep: Keep) -> DataFrame:
    """(node, k, community, part): connected parts of communities."""
    of = lambda end, c: nodes.select(F.col("node").alias(end), F.col("community").alias(c))
    e = keep(e.join(of("src", "_a"), "src").join(of("dst", "_b"), "dst").filter("_a = _b").select("src", "dst", "w", "k"), "inner")
    parts = _degrees(e, nodes).select("node", "k", "n", F.col("community").alias("whole"), F.col("node").alias("community"))
    left, quiet, i = e.count(), 0, 0
    while quiet < 2 and i < rounds:
        of = Window.partitionBy("community")
        state = parts.select("*", F.sum("k").over(of).alias("total"), (F.count("*").over(of) == 1).alias("single"))
        if left <= FEW:
            to = _settled(e, state, state.filter("single AND n > 0"), m2, resolution, True)
            parts = keep(parts.join(to, "node", "left").select("node", "k", "whole", F.coalesce("to", "community").alias("community")), "refined")
            break
        mover = F.col("single") & _half(F.col("node"), i)
        state = state.withColumn("mover", mover).withColumn("open", ~F.col("mover"))
        joins = F.coalesce(F.col("mover") & (F.col("gain") > LEAST), F.lit(False))
        new = _choices(e, state, m2, resolution, "whole", "n", "single", "mover").withColumn("moved", joins)
        new = keep(new.select("node", "k", "whole", F.when(F.col("moved"), F.col("new")).otherwise(F.col("community")).alias("community"), "n", "single", "moved"), "refined")
        moved, left = new.agg(F.max("moved"), F.coalesce(F.sum(F.when(F.col("single") & ~F.col("moved"), F.col("n"))), F.lit(0))).first()
        quiet = 0 if moved else quiet + 1
        parts = new.drop("moved", "single")
        i += 1
    return parts.select("node", "k", F.col("whole").alias("community"), F.col("community").alias("part"))


def undirected(edges: DataFrame, weight: str | None) -> DataFrame:
    """(src, dst, w) in both directions, with the weights of parallel edges summed; loops and edges without weight go."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w")).filter("src <> dst AND w > 0")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _degrees(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with their numbers of edges, n."""
    n = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return nodes.drop("n").join(n, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _contracted(e: DataFrame, of: DataFrame, keep: Keep) -> DataFrame:
    """Edges between the parts of ``of`` (at, part)."""
    a, b = of.select(F.col("at").alias("src"), F.col("part").alias("a")), of.select(F.col("at").alias("dst"), F.col("part").alias("b"))
    return keep(e.join(a, "src").join(b, "dst").filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "edges")


def _followers(e: DataFrame) -> DataFrame:
    """(at, part): vertices with a single neighbour, and that one; of two that have only each other, the greater one."""
    one = e.groupBy(F.col("src").alias("at")).agg(F.count("*").alias("n"), F.min("dst").alias("part")).filter("n = 1").select("at", "part")
    both = one.select(F.col("at").alias("part"), F.col("part").alias("at"), F.lit(True).alias("_both"))
    return one.join(both, ["at", "part"], "left").filter("_both IS NULL OR at > part").select("at", "part")


def _one_by_one(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, of: np.ndarray, m2: float, resolution: float) -> np.ndarray:
    """Community numbers of the vertices 0 to n - 1 of a small graph, through all levels; communities are connected."""
    at = np.arange(len(k))
    while True:
        n = len(k)
        order = np.argsort(src, kind="stable")
        ends = np.searchsorted(src[order], np.arange(n + 1))
        to, ws, ks = dst[order].tolist(), w[order].tolist(), k.tolist()
        near = [list(zip(to[a:b], ws[a:b])) for a, b in zip(ends[:-1], ends[1:])]

        whole = of.tolist()
        total: dict[int, float] = {}
        for c, x in zip(whole, ks):
            total[c] = total.get(c, 0.0) + x
        todo, waits = deque(range(n)), [True] * n
        while todo:
            v = todo.popleft()
            waits[v] = False
            c = _best(near[v], whole, total, whole[v], ks[v], m2, resolution)
            if c is not None:
                total[whole[v]] -= ks[v]
                total[c] += ks[v]
                whole[v] = c
                for u, _ in near[v]:
                    if whole[u] != c and not waits[u]:
                        waits[u] = True
                        todo.append(u)
        part, count, total = list(range(n)), [1] * n, dict(enumerate(ks))
        for v in range(n):
            within = [(u, x) for u, x in near[v] if whole[u] == whole[v]]
            c = _best(within, part, total, part[v], ks[v], m2, resolution) if count[part[v]] == 1 else None
            if c is not None:
                count[v], count[c] = 0, count[c] + 1
                total[v] -= ks[v]
                total[c] += ks[v]
                part[v] = c
        names, new = np.unique(part, return_inverse=True)
        of = np.unique(np.array(whole)[names], return_inverse=True)[1]
        a, b = new[src], new[dst]
        pairs, first = np.unique((a * len(names) + b)[a != b], return_inverse=True)
        src, dst, w = pairs // len(names), pairs % len(names), np.bincount(first, w[a != b], len(pairs))
        k, at = np.bincount(new, k), new[at]
        if len(names) == n:
            break
    # connected parts of communities, among the last graph's vertices
    label, moved = np.arange(len(k)), True
    inside = of[src] == of[dst]
    while moved:
        low = label.copy()
        np.minimum.at(low, src[inside], label[dst[inside]])
        low = low[low]
        moved, label = bool((low != label).any()), low
    return label[at]


def _finished(e: DataFrame, nodes: DataFrame, m2: float, resolution: float) -> DataFrame:
    """(at, community): vertices of a graph of few edges; those without any aren't returned."""
    import pandas as pd

    def run(_: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("node").reset_index(drop=True)
        at = pd.Index(y["node"])
        of = np.unique(y["community"].to_numpy(), return_inverse=True)[1]
        x = x.sort_values(["src", "dst"])
        found = _one_by_one(at.get_indexer(x["src"]), at.get_indexer(x["dst"]), x["w"].to_numpy(), y["k"].to_numpy(), of, m2, resolution)
        first = pd.Series(np.arange(len(y))).groupby(found).transform("min").to_numpy()
        return pd.DataFrame({"at": y["node"], "community": y["node"].to_numpy()[first]})

    kind = nodes.schema["node"].dataType.simpleString()
    linked = nodes.join(e.select(F.col("src").alias("node")).distinct(), "node").select("node", "k", "community")
    one = lambda d: d.withColumn("_one", F.lit(0)).groupBy("_one")
    return one(e.select("src", "dst", "w")).cogroup(one(linked)).applyInPandas(run, f"at {kind}, community {kind}")


def leiden(edges: DataFrame, keep: Keep, weight: str | None = None, resolution: float = 1.0, levels: int = 10, rounds: int = 20) -> DataFrame:
    """(node, community) of all vertices that have an edge to another one; a community is named by its least vertex."""
    e = keep(undirected(edges, weight), "edges")
    m2 = e.agg(F.sum("w")).first()[0]
    if not m2:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("community")).limit(0)
    members = keep(e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("at", F.col("node")), "members")  # which vertex of the level's graph each one is in
    if resolution <= 1:
        members = keep(members.join(_followers(e), "at", "left").select("node", "k", F.coalesce("part", "at").alias("at")), "members")
        e = _contracted(e, members.select(F.col("node").alias("at"), F.col("at").alias("part")), keep)
    nodes = keep(members.groupBy(F.col("at").alias("node")).agg(F.sum("k").alias("k")).withColumn("community", F.col("node")), "nodes")
    for _ in range(levels):
        if e.count() <= FEW:
            break
        weighed = keep(e.join(nodes.select(F.col("node").alias("src"), "k"), "src").select("src", "dst", "w", "k"), "weighed")
        nodes = _moved(weighed, keep(_degrees(e, nodes), "degrees"), m2, resolution, rounds, keep)
        parts = _refined(weighed, nodes, m2, resolution, rounds, keep)
        n_before, n_after = parts.agg(F.count("*"), F.countDistinct("part")).first()
        of = parts.select(F.col("node").alias("at"), "part")
        members = keep(members.join(of, "at").select("node", F.col("part").alias("at")), "members")
        e = _contracted(e, of, keep)
        nodes = keep(parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.min("community").alias("community")), "nodes")
        if n_before == n_after:
            break
    if e.count() <= FEW:
        found = _finished(e, nodes, m2, resolution)
    else:
        of = lambda end, c: nodes.select(F.col("node").alias(end), F.col("community").alias(c))
        inside = e.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a = b AND src < dst").select("src", "dst")
        found = connected_components(inside, keep).select(F.col("node").alias("at"), F.col("component").alias("community"))
    found = keep(members.join(found, "at", "left").select("node", F.coalesce("community", "at").alias("of")), "found")
    names = found.groupBy("of").agg(F.min("node").alias("community"))
    return found.join(names, "of").select("node", "community")


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = None, resolution: float = 1.0) -> float:
    """How much more weight lies inside communities than chance would put there."""
    e = undirected(edges, weight)
    m2 = e.agg(F.sum("w")).first()[0]
    if not m2:
        return 0.0
    of = lambda end, c: communities.select(F.col("node").alias(end), F.col("community").alias(c))
    inside = e.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a = b").agg(F.sum("w")).first()[0] or 0.0
    total = e.groupBy("src").agg(F.sum("w").alias("k")).join(of("src", "a"), "src").groupBy("a").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inside / m2 - resolution * total / (m2 * m2)
