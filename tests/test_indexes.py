"""Indexes against brute force: names, sets, text search, paths; tables that are opened again."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tempolith.functions import analyzers as N
from tempolith.functions import documents as D
from tempolith.operators import consolidate, curve, graph, names, paths, search, signatures, temporal
from tempolith.plans.graph import cut
from tempolith.sources.shared import scratch
from tempolith.sources.writes import BucketedTable
from tempolith.streaming import events


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, r=row, x=x: min(left + 1, r[j] + 1, r[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_near_names(spark, distance):
    rnd = random.Random(distance)
    rows = [(rnd.choice(["t", "u", None]), "".join(rnd.choice("abé") for _ in range(rnd.randrange(7)))) for _ in range(120)] + [("t", None), ("u", "clk_rst"), ("u", "clk_rts"), ("u", "clk_rst")]
    d = spark.createDataFrame(rows, "t string, n string")
    got = [tuple(r) for r in names.near(d, "t", "n", distance).collect()]
    seen = sorted({r for r in rows if r[1] is not None}, key=str)
    want = {(t, a, b, edits(a, b)) for (t, a), (u, b) in itertools.product(seen, seen) if t == u and a < b and edits(a, b) <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_candidates_grow_with_matches(spark):
    """4,000 names of one type and length, of which few are near: no comparison of all with all."""
    rnd = random.Random(5)
    n = spark.createDataFrame([("t", "".join(rnd.choice("abcdefghijklmnop") for _ in range(12))) for _ in range(4000)] + [("t", "x" * 12), ("t", "x" * 11 + "y")], "t string, n string")
    x = names.index(n, "t", "n", 1)
    met = x.groupBy("block", "h").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert met < 100
    assert names.near(n, "t", "n", 1).count() >= 1


def test_consolidation(spark):
    raw = spark.createDataFrame([(1, "m", "Alpha unit", "a"), (2, "m", "ALPHA UNIT ", "b"), (3, "m", "alpha unib", None), (4, "m", "alphx unib", "c"), (5, "r", "alpha unit", "d"), (6, "m", None, "e"), (7, "m", "zed", "")], "key long, type string, name string, description string")
    rel = spark.createDataFrame([(1, 1, 3, "uses"), (2, 2, 4, "uses"), (3, 2, 7, "uses"), (4, 1, 7, "uses"), (5, 98, 99, "uses"), (6, 98, 1, "uses")], "relation long, src long, dst long, type string")
    dry = consolidate.consolidate(raw, rel, cut, 1, 0.5, dry_run=True)
    assert dry["golden"].count() == 5 and dry["candidates"].count() == 2
    c = consolidate.consolidate(raw, rel, cut, 1, 0.5)
    g = {r["name"]: r for r in c["golden"].collect()}
    assert len(g) == 3  # Alpha unit, alpha unib and alphx unib are one, step by step
    one = next(r for r in g.values() if r["merged"] == 2)
    assert one["name"] == "ALPHA UNIT " and set(one["aliases"]) == {"Alpha unit", "alpha unib", "alphx unib"} and one["members"] == 4
    assert one["description"] == "a | b | c"
    assert {(r["golden"], r["raw"]) for r in c["consolidates"].collect() if r["raw"] <= 4} == {(one["golden"], k) for k in (1, 2, 3, 4)}
    r = sorted((x["src"] == one["golden"], x["dst"] == one["golden"], x["evidence"], x["provenance"]) for x in c["relations"].collect())
    assert r == [(False, True, 1, [6]), (True, False, 2, [3, 4]), (True, True, 2, [1, 2])]


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.9, 1.0])
def test_similar_sets(spark, threshold):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), i, [rnd.choice(["Clk", "clk", "rst", "d0", "d1", "d2", "q", None]) for _ in range(rnd.randrange(8))]) for i in range(60)] + [("a", 90, None), ("b", 91, [])]
    d = spark.createDataFrame(rows, "side string, k int, v array<string>")

    def score(x, y):
        x, y = ({e.lower() for e in s or [] if e is not None} for s in (x, y))
        return 0.6 * len(x & y) / len(x | y) + 0.4 * (1 - abs(len(x) - len(y)) / max(len(x), len(y))) if x and y else 0

    for cross in (True, False):
        got = {(r["a"], r["b"]) for r in signatures.similar_sets(d, "side", "k", "v", threshold, cut, cross).collect()}
        want = {(i, j) for (s, i, x), (t, j, y) in itertools.product(rows, rows) if (s < t if cross else i < j) and score(x, y) >= threshold - 1e-12}
        assert got == want
    with pytest.raises(ValueError):
        signatures.similar_sets(d, "side", "k", "v", 0.4, cut)


# --- text search ------------------------------------------------------------------------------------


def test_search_skips_blocks_and_is_exact(spark):
    rnd = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    rare = [f"r{i}" for i in range(2000)]
    docs = [(i, " ".join([rnd.choice(common) for _ in range(rnd.randrange(5, 60))] + [rnd.choice(rare) for _ in range(4)])) for i in range(3000)] + [(5000, None), (5001, "")]
    queries = [(0, "c1 c2 r7 r8"), (1, "c3 r100"), (2, "c1 c2 c3"), (3, "nothing"), (4, None), (5, "r1 r1 r2")]
    d, q = spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(queries, "id int, t string")
    index = search.build(d, "k", "t", scratch(spark, "search-test"))
    found, read = search.top_k(index, search.terms(index, q, "id", "t"), 3, cut)
    tok = {k: (t or "").split() for k, t in docs}
    n, avg = len(docs), sum(map(len, tok.values())) / len(docs)
    df = {}
    for t in tok.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    for i, text in queries:
        want = []
        for k, t in tok.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in set((text or "").split()) if w in t)
            want += [(-s, k)] if s else []
        want = sorted(want)[:3]
        got = [(r["key"], r["score"]) for r in found.filter(F.col("query") == i).orderBy("rank").collect()]
        assert [k for k, _ in got] == [k for _, k in want]
        assert [s for _, s in got] == pytest.approx([-s for s, _ in want])
    blocks = {r["query"]: (r["blocks"], r["read"]) for r in read.collect()}
    assert index.blocks > 40 and blocks[0][0] > 40  # c1 is everywhere
    assert blocks[0][1] < blocks[0][0] / 2 and blocks[1][1] < blocks[1][0] / 2  # the rare tokens rule most blocks out


def test_phrases_and_min_match(spark):
    d = spark.createDataFrame([(1, "a b a b c"), (2, "b a c"), (3, "a a a"), (4, "x")], "k long, t string")
    index = search.build(d, "k", "t", scratch(spark, "phrase-test"))
    q = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "A-B c"), (4, "c a")], "id int, t string")
    assert {tuple(r) for r in search.phrases(index, q, "id", "t").collect()} == {(1, 1, 2), (2, 3, 2), (3, 1, 1)}
    got = {tuple(r) for r in search.min_match(index, search.terms(index, q, "id", "t"), 2).collect()}
    assert got == {(1, 1, 2), (1, 2, 2), (3, 1, 3), (3, 2, 3), (4, 1, 2), (4, 2, 2)}


def test_analyzers(spark):
    one = lambda a, t: spark.range(1).select(a(F.lit(t)).alias("c")).first()["c"]
    assert one(N.ngrams(2, 3), "abcd") == ["ab", "bc", "cd", "abc", "bcd"]
    assert one(N.ngrams(3, 3, preserve=True), "ab") == ["ab"]
    assert one(N.edge_ngrams(2, 5), "abcd") == ["ab", "abc", "abcd"]
    assert one(N.norm(), "Crème BRÛLÉE") == ["creme brulee"]
    assert one(N.pipeline(N.norm(accent=True), N.multi_delimiter([",", ", "])), "A, É,b") == ["a", "é", "b"]
    assert one(N.identity, "A b") == ["A b"]


def test_documents_of_unknown_shape(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    kinds = {"null": "null", "true": "bool", "1": "number", "-2.5e3": "number", '"x"': "string", "[]": "array", '{"a":[1]}': "object", "{broken": None}
    assert {k: one(D.typename(F.lit(k))) for k in kinds} == kinds
    assert one(D.merge_recursive(F.lit('{"a":{"b":1,"c":2},"d":1}'), F.lit('{"a":{"c":3},"d":{"e":1}}'))) == '{"a":{"b":1,"c":3},"d":{"e":1}}'
    assert one(D.unset_recursive(F.lit('{"a":{"x":1,"y":[{"x":2,"z":3}]},"x":0}'), "x")) == '{"a":{"y":[{"z":3}]}}'
    assert one(D.keep_recursive(F.lit('{"a":{"x":1,"y":2},"x":{"b":1},"c":3}'), "a", "x")) == '{"a":{"x":1},"x":{}}'
    assert one(D.merge_recursive(F.lit("[1]"), F.lit("{}"))) is None and one(D.unset_recursive(F.lit(None).cast("string"), "x")) is None
    assert [tuple(r) for r in one(D.entries(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))))] == [("a", 2), ("b", 1)]


# --- paths --------------------------------------------------------------------------------------------


def test_k_shortest_paths(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(8), rnd.randrange(8), float(rnd.randrange(1, 4))) for _ in range(14)] + [(0, 0, 1.0), (2, 7, 9.0), (2, 7, 2.0)]
    near = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            if x != y:
                near.setdefault(x, {})[y] = min(w, near.get(x, {}).get(y, 99))
    every = []

    def go(p, c):
        if p[-1] == 7:
            every.append((c, p))
            return
        for y, w in near.get(p[-1], {}).items():
            if y not in p:
                go([*p, y], c + w)

    go([0], 0.0)
    d = spark.createDataFrame(edges, "src long, dst long, w double")
    got = [(r["cost"], r["path"]) for r in paths.k_shortest_paths(d, 0, 7, 5, "any", "w", cut).orderBy("rank").collect()]
    assert got == sorted(every)[:5]
    least = min(len(p) for _, p in every)
    assert sorted(r["path"] for r in paths.all_shortest_paths(d, 0, 7, "any", cut).collect()) == sorted(p for _, p in every if len(p) == least)
    assert paths.k_shortest_paths(d, 0, 99, 3, keep=cut).count() == 0
    assert [r["path"] for r in paths.k_shortest_paths(d, 3, 3, 3, keep=cut).collect()] == [[3]]
    with pytest.raises(ValueError):
        paths.k_shortest_paths(d.withColumn("w", -F.col("w")), 0, 7, 2, weight="w", keep=cut)


def test_path_counts_on_a_grid(spark):
    n = 7
    grid = [(i * n + j, x * n + y) for i in range(n) for j in range(n) for x, y in ((i + 1, j), (i, j + 1)) if x < n and y < n]
    got = {r["node"]: (r["distance"], int(r["paths"])) for r in paths.shortest_path_counts(spark.createDataFrame(grid, "src long, dst long"), 0, keep=cut).collect()}
    assert got == {i * n + j: (i + j, math.comb(i + j, i)) for i in range(n) for j in range(n)}


def test_betweenness_exact_and_sampled(spark):
    rnd = random.Random(3)
    n, e = 24, {(rnd.randrange(24), rnd.randrange(24)) for _ in range(60)}
    near = {v: sorted({b for a, b in e if a == v}) for v in range(n)}
    want = dict.fromkeys({v for p in e for v in p}, 0.0)
    for s in want:  # Brandes, one source after another
        order, depth, paths, before = [s], {s: 0}, {s: 1}, {}
        for v in order:
            for u in near[v]:
                if u not in depth:
                    depth[u], paths[u] = depth[v] + 1, 0
                    order.append(u)
                if depth[u] == depth[v] + 1:
                    paths[u] += paths[v]
                    before.setdefault(u, []).append(v)
        dep = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in before.get(u, []):
                dep[v] += paths[v] / paths[u] * (1 + dep[u])
            if u != s:
                want[u] += dep[u]
    d = spark.createDataFrame(sorted(e), "src long, dst long")
    got = {r["node"]: r["score"] for r in graph.betweenness(d, cut).collect()}
    assert got == pytest.approx(want)
    some = {r["node"]: r["score"] for r in graph.betweenness(d, cut, error=0.45).collect()}  # fewer sources than vertices
    m = len(want)
    assert set(some) == set(want) and some != pytest.approx(want)
    assert max(abs(some[v] - want[v]) for v in want) <= 0.45 * m * (m - 1)


# --- curves -------------------------------------------------------------------------------------------


def test_boxes_on_a_curve_read_few_files(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(1000), rnd.uniform(-5, 5)) for i in range(6000)] + [(9000, None, 1.0), (9001, 5, None)]
    path = scratch(spark, "curve-test")
    c = curve.write(spark.createDataFrame(rows, "id int, a int, b double"), ["a", "b"], path, 40, bits=8)
    every = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    read = []
    for low, high in (([100, -1.0], [150, 0.0]), ([0, -5.0], [500, 0.0]), ([None, None], [None, None]), ([990, None], [None, -4.5]), ([7, 3.0], [6, 4.0])):
        got = {r["id"] for r in curve.box(spark, path, c, low, high).collect()}
        ok = lambda v, x, y: (x is None or (v is not None and v >= x)) and (y is None or (v is not None and v <= y))
        assert got == {i for i, a, b in rows if ok(a, low[0], high[0]) and ok(b, low[1], high[1])}
        near = F.lit(False)
        for x, y in c.intervals(low, high):
            near = near | F.col("_place").between(x, y)
        read.append(spark.read.parquet(path).filter(near).select(F.input_file_name()).distinct().count())
    assert every == 40 and read[0] <= 3 and read[1] <= 16 and read[2] == 40 and read[4] == 0
    plan = curve.box(spark, path, c, [100, -1.0], [150, 0.0])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(_place" in plan  # pushed to the scan


# --- versions -----------------------------------------------------------------------------------------


def test_live_versions_without_making_all(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(6), rnd.randrange(20), i, f"v{i}") for i in range(60)]
    d = spark.createDataFrame(rows, "k int, ts long, o int, v string")
    every = temporal.close_intervals(d, ["k"], "ts", ["o"])
    for t in (-1, 0, 7, 19, 30):
        want = {(r["k"], r["valid_from_ts"], r["valid_to_ts"], r["v"]) for r in temporal.as_of(every, t).collect()}
        got = temporal.live_at(d, ["k"], "ts", ["o"], ["v"], t, until=True).collect()
        assert {(r["k"], r["valid_from_ts"], r["valid_to_ts"], r["v"]) for r in got} == want and len(got) == len(want)
    two = temporal.live_at(d, ["k"], "ts", ["o"], ["v"], 5, 15)
    assert {tuple(r) for r in temporal.diff_at(two, 5, 15, "v").collect()} == {tuple(r) for r in temporal.diff(every, 5, 15, "v").collect()}


def test_streamed_versions_of_shuffled_runs(spark):
    """Events out of order across two runs of a query, which is stopped in between, close the versions of the batch."""
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(4), 1_700_000_000 + rnd.randrange(3600 * 20)) for i in range(120)]
    rows.sort(key=lambda r: r[2] + rnd.randrange(3000))  # up to 50 minutes late
    path, out, state = (scratch(spark, f"versions-{x}") for x in ("in", "out", "state"))
    put = lambda x: spark.createDataFrame(x, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(path)
    for part in (rows[:60], rows[60:], [(-1, -1, 1_800_000_000)]):
        put(part)
        s = events.versions(events.stream(spark, path, "event_id long, user_id long, ts timestamp", files_per_trigger=1))
        events.run_to_table(s, out, state)
    got = [tuple(r) for r in spark.read.schema(s.schema).parquet(out).collect()]
    want = []
    for u in range(4):
        mine = sorted((t * 1_000_000, e) for e, v, t in rows if v == u)
        want += [(u, e, t, until) for (t, e), (until, _) in zip(mine, mine[1:])]
    assert sorted(got) == sorted(want)


# --- tables that are opened again ---------------------------------------------------------------------


def test_a_restarted_table_goes_on(spark):
    path = scratch(spark, "restart-test")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, at long, v string")
    BucketedTable(spark, path, "k", "at", buckets=8).merge(rows(*[(i, 1, "old") for i in range(200)]), 0)
    again = BucketedTable(spark, path, "k", "at", buckets=8)  # as after a restart of the driver
    assert again.read().count() == 200
    again.merge(rows((7, 2, "new"), (7, 0, "older"), (900, 1, "more")), 1)
    again.merge(rows((7, 9, "replayed")), 1)
    third = BucketedTable(spark, path, "k", "at", buckets=8)
    third.merge(rows((8, 9, "late")), 0)
    got = {r["k"]: r["v"] for r in third.read().collect()}
    assert len(got) == 201 and got[7] == "new" and got[8] == "old" and got[900] == "more"
    with pytest.raises(ValueError):
        BucketedTable(spark, path, "k", "at", buckets=9)


def test_a_merge_that_fails_leaves_the_table(spark, monkeypatch):
    path = scratch(spark, "failed-test")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, at long, v string")
    t = BucketedTable(spark, path, "k", "at", buckets=2)
    t.merge(rows((1, 1, "a")), 0)
    monkeypatch.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.merge(rows((1, 2, "b"), (2, 1, "c")), 1)
    t = BucketedTable(spark, path, "k", "at", buckets=2)
    assert [(r["k"], r["v"]) for r in t.read().collect()] == [(1, "a")]
    t.merge(rows((1, 2, "b"), (2, 1, "c")), 1)
    assert {(r["k"], r["v"]) for r in t.read().collect()} == {(1, "b"), (2, "c")}
