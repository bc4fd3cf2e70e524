"""What the third review found: each test failed before."""

import datetime
import random

import duckdb
from compare import same_rows
from pyspark.sql import functions as F

from tempolith.operators import graph as G
from tempolith.operators import relational as rel
from tempolith.operators import search, signatures
from tempolith.operators import similarity as sim
from tempolith.operators.components import connected_components
from tempolith.plans import CORE
from tempolith.plans.graph import cut
from tempolith.sources.shared import scratch


def against_sql(spark, name, path, **tables):
    """A query and its SQL over ``tables``, which are written under ``path``."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    same_rows(CORE.queries()[name](spark, str(path)), con.sql(CORE.oracle_sql()[name]))


def test_bursts_of_fractional_seconds(spark, tmp_path):
    start, rnd = datetime.datetime(2024, 1, 1), random.Random(1)
    micros = [500_000, 1_500_000, 2_499_999, 3_500_000] + [rnd.randrange(10) * 500_000 for _ in range(40)]
    times = [start + datetime.timedelta(microseconds=m) + datetime.timedelta(weeks=i % 3) for i, m in enumerate(micros)]
    rows = [(i, i % 2, t) for i, t in enumerate(times)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    against_sql(spark, "win_burst", tmp_path, events=e)


def test_type_pairs_are_counted_not_made(spark, tmp_path):
    """So many pairs that nothing but counting them ends: 1.8 thousand millions in one group."""
    n = 60_000
    p = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("gear").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("ECONOMY LARGE").alias("p_type"))
    p.write.parquet(f"{tmp_path}/part.parquet")
    got = CORE.queries()["flt_type_matrix"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("LARGE", "LARGE", n * (n - 1) // 2)]
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_ordered_pairs_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("xy"), rnd.randrange(-20, 40) if rnd.random() < 0.95 else None, rnd.randrange(2), rnd.randrange(3)) for _ in range(200)]
    want = {g: sum(a[2] * b[3] for a in rows for b in rows if a[0] == b[0] == g and None not in (a[1], b[1]) and a[1] < b[1]) for g in "xy"}
    d = spark.createDataFrame(rows, "g string, k long, a int, b int")
    assert {tuple(r) for r in rel.ordered_pairs(d, ["g"], "k", "a", "b", span=7).collect()} == set(want.items())


def test_components_of_a_chain_in_any_order(spark):
    """Labels used to walk from one low id to the next: 146 rounds, where 60 were allowed."""
    ids = list(range(500))
    random.Random(1).shuffle(ids)
    edges = list(zip(ids[:300], ids[1:301])) + list(zip(ids[301:499], ids[302:]))
    kept = []
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), lambda d, name: kept.append(name) or cut(d, name))
    want = {v: min(part) for part in (ids[:301], ids[301:]) for v in part}
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert len(kept) <= 20


def test_large_tables_of_loops_are_not_broadcast(spark):
    few, many = (cut(spark.range(n).withColumnRenamed("id", "k"), "test") for n in (100, 20_000))
    plan = lambda d: d._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(many.join(many.select(F.col("k").alias("o")), F.col("k") == F.col("o")))
    assert "BroadcastHashJoin" in plan(few.join(few.select(F.col("k").alias("o")), F.col("k") == F.col("o")))
    assert cut(spark.range(5).filter("id > 9"), "test").count() == 0


def test_copies_of_sets_are_compared_once(spark):
    """Pairs of copies are in the result, but no table on the way has a row for each."""
    rows = [(k % 2, k, ["a", "b", "c"] if k < 300 else ["c", "B", "a"] if k < 320 else ["a", "b", "d"]) for k in range(400)]
    kept = {}

    def keep(d, name):
        kept[name] = cut(d, name)
        return kept[name]

    d = spark.createDataFrame(rows, "side int, k long, v array<string>")
    pairs = [(a, b) for _, a, x in rows for _, b, y in rows if signatures.least_jaccard(0.75) <= len({*map(str.lower, x)} & {*map(str.lower, y)}) / len({*map(str.lower, x)} | {*map(str.lower, y)})]
    for cross in (True, False):
        want = sorted((a, b) for a, b in pairs if (a % 2 < b % 2 if cross else a < b))
        got = signatures.similar_sets(d, "side", "k", "v", 0.75, keep, cross)
        assert sorted((r["a"], r["b"]) for r in got.collect()) == want
        assert all(x.count() <= len(rows) for x in kept.values()) and kept["scored"].count() <= 16


def test_index_is_made_block_by_block(spark):
    """A block's rows lie in one file, so texts move once; no table on the way has a row a query, token and block."""
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(30))) for i in range(2000)]
    index = search.build(spark.createDataFrame(docs, "k long, t string"), "k", "t", scratch(spark, "blocks-test"))
    assert index.rows.select("block", F.input_file_name().alias("f")).distinct().groupBy("block").count().filter("count > 1").count() == 0
    q = spark.createDataFrame([(i, docs[i][1]) for i in range(5)], "id long, t string")
    kept = {}

    def keep(d, name):
        kept[name] = cut(d, name).count()
        return cut(d, name)

    found, _ = search.top_k(index, search.terms(index, q, "id", "t"), 3, keep)
    assert {r["query"] for r in found.filter("rank = 1 AND query = key").collect()} == set(range(5))
    assert max(kept.values()) <= max(5 * index.blocks, 5 * 24)
    assert {(r["query"], r["key"]) for r in search.phrases(index, q, "id", "t", cut).collect()} >= {(i, i) for i in range(5)}


def test_best_scores_by_label_are_taken_in_the_task(spark):
    """A row an item, label and block, not one a pair."""
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)], rnd.choice([1, 2, None])) for i in range(300)]
    d = spark.createDataFrame(rows, "k long, v array<float>, label int")
    a, b = d.filter("k < 20"), d.filter("k >= 20")
    got = sim.best_by_label(a, b, "k", "v", "label", block=64)
    pairs = sim.similar_pairs(a, b, "k", "v", -1.0).join(d.select(F.col("k").alias("b"), "label"), "b").groupBy("a", "label").agg(F.max("score").alias("score"))
    rounded = lambda x: {(r["a"], r["label"], round(r["score"], 9)) for r in x.collect()}
    assert rounded(got) == rounded(pairs) and got.count() == 60


def test_tasks_of_distinct_edges_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(G, "EDGES", 1000)
    e = spark.range(40_000).select((F.col("id") % 50).alias("src"), (F.col("id") % 9000).alias("dst"))
    d = G.distinct_edges(e)
    assert d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 1500
    got = {r["node"]: (r["out_degree"], r["in_degree"], r["degree"]) for r in G.degrees(d.withColumn("dst", F.col("dst") + 100)).collect()}
    assert d.count() == 9000 and len(got) == 9050 and got[3] == (180, 0, 180) and got[103] == (0, 1, 1)
