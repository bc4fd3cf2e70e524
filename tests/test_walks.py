"""Walks, communities and approximate vector search against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolith.operators import ann, leiden, walks
from tempolith.plans.graph import cut, start
from tempolith.sources.shared import scratch


def brute_walks(edges, at, low, high, directions, unique_vertices, unique_edges):
    e = []
    for i, a, b, t, w in edges:
        way = directions if isinstance(directions, str) else directions.get(t)
        if way in ("outbound", "any"):
            e.append((i, a, b, w))
        if way == "inbound" or (way == "any" and a != b):
            e.append((i, b, a, w))
    out, todo = [], [((at,), (), 0.0)]
    while todo:
        p, used, c = todo.pop()
        if len(used) >= low:
            out.append((len(used), c, list(p), list(used)))
        if len(used) < high:
            todo += [((*p, b), (*used, i), c + w) for i, a, b, w in e if a == p[-1] and not (unique_vertices == "path" and b in p) and not (unique_edges == "path" and i in used)]
    return sorted(out)


@pytest.mark.parametrize("unique_vertices,unique_edges", [("none", "path"), ("path", "none"), ("path", "path"), ("none", "none")])
def test_walks(spark, unique_vertices, unique_edges):
    rnd = random.Random(7)
    edges = [(i, rnd.randrange(5), rnd.randrange(5), rnd.choice("xyz"), float(rnd.randrange(1, 4))) for i in range(9)] + [(20, 1, 1, "x", 1.0)]
    d = spark.createDataFrame(edges, "edge long, src long, dst long, type string, w double")
    for directions in ("any", {"x": "outbound", "y": "inbound", "z": "any"}):
        got = sorted((r["depth"], r["cost"], r["path"], r["edges"]) for r in walks.walks(start(spark, 1), d, 1, 3, directions, unique_vertices, unique_edges, "w", keep=cut).collect())
        assert got == brute_walks(edges, 1, 1, 3, directions, unique_vertices, unique_edges)


def test_orders(spark):
    d = spark.createDataFrame([(1, 0, 1, "t", 5.0), (2, 0, 2, "t", 1.0), (3, 2, 1, "t", 1.0), (4, 1, 3, "t", 1.0), (5, 0, 1, "t", 9.0)], "edge long, src long, dst long, type string, w double")
    paths = lambda **k: [r["edges"] for r in walks.walks(start(spark, 0), d, 1, 3, weight="w", **k).collect()]
    assert paths(order="bfs") == [[1], [5], [2], [1, 4], [5, 4], [2, 3], [2, 3, 4]]
    assert paths(order="dfs") == [[1], [5], [1, 4], [5, 4], [2], [2, 3], [2, 3, 4]]
    assert paths(order="weighted") == [[2], [2, 3], [2, 3, 4], [1], [1, 4], [5], [5, 4]]
    assert paths(order="weighted", unique_vertices="global") == [[2], [2, 3], [2, 3, 4]]
    assert paths(order="bfs", unique_vertices="global") == [[1], [2], [1, 4]]
    with pytest.raises(ValueError):
        paths(order="dfs", unique_vertices="global")
    got = {r["node"]: r["cost"] for r in walks.cheapest(start(spark, 0), d, "w", 2.0, cut).collect()}
    assert got == {0: 0.0, 2: 1.0, 1: 2.0, 3: 3.0}
    with pytest.raises(ValueError):
        walks.cheapest(start(spark, 0), d.withColumn("w", -F.col("w")), "w", 2.0, cut)


# --- communities ----------------------------------------------------------------------------------------


def brute_modularity(edges, of):
    m2 = 2 * sum(w for _, _, w in edges)
    k, inside = {}, 0.0
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inside += 2 * w * (of[a] == of[b])
    total = {}
    for v, x in k.items():
        total[of[v]] = total.get(of[v], 0) + x
    return inside / m2 - sum(t * t for t in total.values()) / m2**2


def louvain(edges):
    """A plain one, vertex after vertex, level after level."""
    members = {v: v for a, b, _ in edges for v in (a, b)}
    e = [(a, b, w) for a, b, w in edges]
    m2 = 2 * sum(w for _, _, w in e)
    while True:
        near, k = {}, {}
        for a, b, w in e:
            k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
            if a != b:
                near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0) + w
                near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0) + w
        of, tot = {v: v for v in k}, dict(k)
        moved = anything = True
        anything = False
        while moved:
            moved = False
            for v in sorted(k):
                tot[of[v]] -= k[v]
                into = {of[v]: 0.0}
                for u, w in near.get(v, {}).items():
                    into[of[u]] = into.get(of[u], 0) + w
                best = max(sorted(into), key=lambda c: (into[c] - tot[c] * k[v] / m2, c == of[v]))
                if best != of[v] and into[best] - tot[best] * k[v] / m2 > into[of[v]] - tot[of[v]] * k[v] / m2 + 1e-12:
                    of[v] = best
                    moved = anything = True
                tot[of[v]] += k[v]
        members = {v: of[c] for v, c in members.items()}
        if not anything:
            return members
        merged = {}
        for a, b, w in e:
            key = tuple(sorted((of[a], of[b])))
            merged[key] = merged.get(key, 0) + w
        e = [(a, b, w) for (a, b), w in merged.items()]


def test_leiden(spark):
    rnd = random.Random(11)
    groups = [range(0, 12), range(12, 20), range(20, 35)]
    pairs = {p for g in groups for p in itertools.combinations(g, 2) if rnd.random() < 0.5} | {tuple(sorted((rnd.randrange(35), rnd.randrange(35)))) for _ in range(14)}
    edges = [(a, b, float(rnd.randrange(1, 4))) for a, b in sorted(pairs) if a != b]
    d = spark.createDataFrame([*edges, (3, 3, 50.0), (1, 2, 0.0)], "src long, dst long, w double")
    found = leiden.leiden(d, cut, "w")
    of = {r["node"]: r["community"] for r in found.collect()}
    assert set(of) == {v for a, b, _ in edges for v in (a, b)}
    q = brute_modularity(edges, of)
    assert leiden.modularity(d, found, "w") == pytest.approx(q)
    assert q >= brute_modularity(edges, louvain(edges)) - 0.01
    for c in set(of.values()):  # connected, and named by its least vertex
        some = {v for v in of if of[v] == c}
        assert min(some) == c
        seen, todo = {c}, [c]
        while todo:
            v = todo.pop()
            for a, b, _ in edges:
                for x, y in ((a, b), (b, a)):
                    if x == v and y in some and y not in seen:
                        seen.add(y)
                        todo.append(y)
        assert seen == some
    assert leiden.leiden(d.limit(0), cut).count() == 0


# --- vectors --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_approximate_neighbours(spark, metric):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 2500)] + 0.5 * rng.normal(size=(2500, 24))).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [float("nan")] * 24), (9003, [])]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    q = ann.fit(d, "id", "v", 40, parts=8, entries=32, metric=metric, sample=2000)
    index = ann.build(d, "id", "v", q, scratch(spark, "ann-test"))
    assert sum(index.sizes.values()) == 2500
    got = {}
    for r in ann.near(index, d.filter("id % 25 = 0"), "id", "v", 10, probes=10).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 2500, 25):
        s = u @ u[i] if metric == "cosine" else -np.linalg.norm(x - x[i], axis=1)
        s[i] = -np.inf
        want = set(np.argsort(-s)[:10].tolist())
        mine = sorted(got[i])
        assert len(mine) == 10 and i not in {k for _, k, _ in mine}
        assert [s for _, _, s in mine] == pytest.approx([s[k] if metric == "cosine" else -s[k] for _, k, _ in mine], abs=1e-6)
        hits += len(want & {k for _, k, _ in mine})
    assert hits >= 900  # recall of 0.9
