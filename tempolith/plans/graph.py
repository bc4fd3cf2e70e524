"""Graph queries: a tree of parts, a ring of suppliers, and the typed chain of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import people
from ..operators.components import connected_components
from ..registry import CORE
from ..tables import load, rounded_seconds

q = CORE.query


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a loop: a checkpoint in the cluster's shared folder."""
    from ..sources.shared import checkpointed

    return checkpointed(df)


def tree(spark: SparkSession, d: str) -> DataFrame:
    """DEPENDS_ON: part p on p div 3."""
    return load(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst"), F.lit("DEPENDS_ON").alias("type"))


def ring(spark: SparkSession, d: str) -> DataFrame:
    """Supplier s to (7 s + 1) mod n: a few cycles."""
    s = load(spark, d, "supplier")
    n = s.agg(F.count("*").alias("n"))
    return s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 1) % F.col("n")).alias("dst"))


def start(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node long")


TREE = "SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0"
RING = "SELECT s_suppkey AS src, (s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier) AS dst FROM supplier"


@q("GR-01", oracle=f"SELECT src AS node, dst AS neighbour FROM ({TREE}) WHERE src IN (5, 17, 80)")
def gr_hop_out(spark: SparkSession, d: str) -> DataFrame:
    return g.hop(start(spark, 5, 17, 80), tree(spark, d), "outbound", ["DEPENDS_ON"]).select("node", "neighbour")


@q("GR-01", oracle=f"SELECT dst AS node, src AS neighbour FROM ({TREE}) WHERE dst IN (5, 17, 80)")
def gr_hop_in(spark: SparkSession, d: str) -> DataFrame:
    return g.hop(start(spark, 5, 17, 80), tree(spark, d), "inbound").select("node", "neighbour")


@q("GR-01", oracle=f"SELECT src AS node, dst AS neighbour FROM ({TREE}) WHERE src IN (5, 17, 80) UNION ALL SELECT dst, src FROM ({TREE}) WHERE dst IN (5, 17, 80)")
def gr_hop_any(spark: SparkSession, d: str) -> DataFrame:
    return g.hop(start(spark, 5, 17, 80), tree(spark, d), "any").select("node", "neighbour")


@q("GR-02", "GR-03", "GR-25", oracle=f"""
WITH RECURSIVE e AS ({TREE}), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
w AS (SELECT 40::BIGINT AS node, 0 AS depth, [40::BIGINT] AS path UNION ALL SELECT u.dst, depth + 1, list_append(path, u.dst) FROM w JOIN u ON w.node = u.src WHERE depth < 4 AND NOT list_contains(path, u.dst))
SELECT 40::BIGINT AS start, node, depth, array_to_string(path, '>') AS path FROM w WHERE depth BETWEEN 1 AND 4""")
def gr_traverse_path(spark: SparkSession, d: str) -> DataFrame:
    t = g.traverse(start(spark, 40), tree(spark, d), 1, 4, "any", "path")
    return t.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@q("GR-03", oracle=f"""
WITH RECURSIVE e AS ({RING}), w AS (SELECT 3::BIGINT AS node, 0 AS depth UNION ALL SELECT e.dst, depth + 1 FROM w JOIN e ON w.node = e.src WHERE depth < 8)
SELECT node, depth FROM w WHERE depth >= 2""")
def gr_traverse_none(spark: SparkSession, d: str) -> DataFrame:
    return g.traverse(start(spark, 3), ring(spark, d), 2, 8, "outbound", "none").select("node", "depth")


@q("GR-03", "GR-11", oracle=f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT 2::BIGINT AS node, 0 AS depth UNION SELECT e.src, depth + 1 FROM w JOIN e ON w.node = e.dst WHERE depth < 5) SELECT 2::BIGINT AS start, node, min(depth) AS depth FROM w WHERE node <> 2 GROUP BY node""")
def gr_impact(spark: SparkSession, d: str) -> DataFrame:
    """All that depends on part 2, with the distance."""
    return g.reachable(start(spark, 2), tree(spark, d), 5, "inbound", keep=cut)


@q("GR-05", oracle=f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT e.src, depth + 1 FROM w JOIN e ON w.node = e.dst WHERE depth < 5 AND (depth = 0 OR node % 2 = 1)) SELECT node, depth FROM w WHERE depth >= 1""")
def gr_prune(spark: SparkSession, d: str) -> DataFrame:
    return g.traverse(start(spark, 1), tree(spark, d), 1, 5, "inbound", "path", prune=lambda n: n % 2 == 0).select("node", "depth")


@q("GR-06", oracle=f"""
WITH e AS ({TREE}) SELECT a.src AS n1, b.src AS n2, c.src AS n3 FROM e a JOIN e b ON b.dst = a.src JOIN e c ON c.dst = b.src WHERE a.dst = 4 AND b.src % 2 = 0 AND c.src % 3 = 1""")
def gr_level_filters(spark: SparkSession, d: str) -> DataFrame:
    e = tree(spark, d)
    return g.typed_chain(start(spark, 4), [(e, "dst", "src", None), (e, "dst", "src", F.col("src") % 2 == 0), (e, "dst", "src", F.col("src") % 3 == 1)]).select("n1", "n2", "n3")


@q("GR-07", oracle="""
SELECT c_custkey, o_orderkey, l_suppkey, CAST(2 AS BIGINT) AS nations FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey AND o_totalprice > 400000""")
def gr_path_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Paths over at least two nations."""
    o = load(spark, d, "orders").filter("o_totalprice > 400000").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return p.withColumn("nations", F.size(F.array_distinct(F.array("c_nationkey", "s_nationkey"))).cast("long")).filter("nations >= 2").select("c_custkey", "o_orderkey", "l_suppkey", "nations")


@q("GR-09", "GR-04", oracle=f"""
WITH RECURSIVE e AS ({TREE}), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
w AS (SELECT 100::BIGINT AS node, 0 AS depth, [100::BIGINT] AS path UNION ALL SELECT u.dst, depth + 1, list_append(path, u.dst) FROM w JOIN u ON w.node = u.src WHERE depth < 9 AND w.node <> 37 AND NOT list_contains(path, u.dst) AND (u.dst < w.node OR depth >= 4))
SELECT array_to_string(path, '>') AS path, CAST(depth AS DOUBLE) AS cost FROM w WHERE node = 37 ORDER BY depth, path LIMIT 1""")
def gr_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    p = g.shortest_path(tree(spark, d).select("src", "dst"), 100, 37, "any", keep=cut)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "cost")


@q("GR-09", oracle="""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst, 1 + abs(c_nationkey - s_nationkey) % 5 AS w FROM (SELECT DISTINCT n_nationkey AS c_nationkey FROM nation) a JOIN (SELECT DISTINCT n_nationkey AS s_nationkey FROM nation) b ON (a.c_nationkey * 3 + b.s_nationkey) % 6 = 0 AND a.c_nationkey <> b.s_nationkey),
p AS (SELECT 0 AS node, 0 AS cost, [0] AS path UNION ALL SELECT e.dst, cost + w, list_append(path, e.dst) FROM p JOIN e ON p.node = e.src WHERE len(path) < 6 AND NOT list_contains(path, e.dst) AND cost + w <= 12)
SELECT CAST(min(cost) AS DOUBLE) AS cost FROM p WHERE node = 18""")
def gr_shortest_weighted(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    e = n.crossJoin(n.withColumnRenamed("src", "dst")).filter("(src * 3 + dst) % 6 = 0 AND src <> dst").withColumn("w", 1 + F.abs(F.col("src") - F.col("dst")) % 5)
    return g.shortest_path(e, 0, 18, "outbound", "w", keep=cut).select("cost")


@q("GR-12", oracle=f"""
WITH RECURSIVE e AS ({RING}), w AS (SELECT src AS start, dst AS node, 1 AS length FROM e UNION ALL SELECT start, e.dst, length + 1 FROM w JOIN e ON w.node = e.src WHERE w.node <> start AND length < 10)
SELECT min(start) AS node, length FROM (SELECT start, length, (SELECT min(x.node) FROM w x WHERE x.start = w.start AND x.length <= w.length) AS least FROM w WHERE node = start AND length >= 2) GROUP BY least, length""")
def gr_cycles(spark: SparkSession, d: str) -> DataFrame:
    return g.cycles(ring(spark, d), 2, 10, keep=cut).select("node", "length")


@q("GR-13", oracle=f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT src AS start, dst AS node, 1 AS depth FROM e UNION ALL SELECT start, e.dst, depth + 1 FROM w JOIN e ON w.node = e.src)
SELECT start AS node, max(depth) AS depth FROM w GROUP BY 1 UNION ALL SELECT 0, 0""")
def gr_depth(spark: SparkSession, d: str) -> DataFrame:
    return g.depth_of(tree(spark, d).select("src", "dst"), 20, cut)


@q("GR-14", oracle=f"""
WITH e AS ({TREE}), v AS (SELECT p_partkey AS node FROM part)
SELECT node, CASE WHEN node NOT IN (SELECT dst FROM e) THEN 'root' ELSE 'leaf' END AS kind FROM v WHERE node NOT IN (SELECT dst FROM e) OR node NOT IN (SELECT src FROM e)""")
def gr_roots_leaves(spark: SparkSession, d: str) -> DataFrame:
    e, v = tree(spark, d), load(spark, d, "part").select(F.col("p_partkey").alias("node"))
    roots = v.join(e.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("kind", F.lit("root"))
    return roots.unionByName(v.join(e.select(F.col("src").alias("node")), "node", "left_anti").withColumn("kind", F.lit("leaf")))


@q("GR-14", "GR-20", oracle=f"SELECT dst AS node, count(*) AS reused FROM ({TREE}) GROUP BY 1 ORDER BY reused DESC, node LIMIT 15")
def gr_most_reused(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("reused")).orderBy(F.desc("reused"), "node").limit(15)


@q("GR-15", oracle="""
WITH t AS (SELECT DISTINCT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id FROM events)
SELECT src, dst, count(*) AS users FROM t WHERE dst IS NOT NULL GROUP BY 1, 2""")
def gr_transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = load(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), "user_id").filter("dst IS NOT NULL").distinct()
    return t.groupBy("src", "dst").agg(F.count("*").alias("users"))


@q("GR-15", oracle=f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({RING}) WHERE src % 4 <> 1), w AS (SELECT 0::BIGINT AS node UNION SELECT e.dst FROM w JOIN e ON w.node = e.src)
SELECT s_suppkey AS state, CASE WHEN s_suppkey NOT IN (SELECT node FROM w) THEN 'unreachable' ELSE 'dead_end' END AS problem FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM w) OR s_suppkey NOT IN (SELECT src FROM e)""")
def gr_fsm_problems(spark: SparkSession, d: str) -> DataFrame:
    """States that the reset state doesn't reach, and reached ones without a way out."""
    e = ring(spark, d).filter("src % 4 <> 1")
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    live = g.traverse(start(spark, 0), e, 0, 40, "outbound", "global", keep=cut).select("node").distinct()
    lost = s.join(live, "node", "left_anti").withColumn("problem", F.lit("unreachable"))
    dead = s.join(live, "node", "left_semi").join(e.select(F.col("src").alias("node")), "node", "left_anti").withColumn("problem", F.lit("dead_end"))
    return lost.unionByName(dead).withColumnRenamed("node", "state")


@q("GR-16", oracle=f"""
WITH e AS ({TREE}), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), h AS (SELECT src AS node, dst AS other FROM u WHERE src IN (7, 30) UNION SELECT a.src, b.dst FROM u a JOIN u b ON a.dst = b.src WHERE a.src IN (7, 30)) SELECT * FROM h WHERE node <> other""")
def gr_ego(spark: SparkSession, d: str) -> DataFrame:
    t = g.traverse(start(spark, 7, 30), tree(spark, d), 1, 2, "any", "global")
    return t.select(F.col("start").alias("node"), F.col("node").alias("other")).distinct().filter("node <> other")


@q("GR-17", "PL-02", oracle=f"""
WITH RECURSIVE e AS ({RING}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT s_suppkey AS start, s_suppkey AS node FROM supplier UNION SELECT start, u.dst FROM w JOIN u ON w.node = u.src)
SELECT start AS node, min(node) AS component FROM w WHERE start IN (SELECT src FROM u WHERE src <> dst) GROUP BY start""")
def gr_components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(ring(spark, d), cut)


def _labels_sql(rounds: int) -> str:
    """The rounds one after another; rounds after the last change change nothing."""
    out = f"WITH t AS ({TREE}), e AS MATERIALIZED (SELECT src, dst FROM t WHERE src <> dst UNION SELECT dst, src FROM t WHERE src <> dst), l0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS community FROM e)"
    for i in range(rounds):
        out += f""", l{i + 1} AS MATERIALIZED (SELECT node, community FROM (SELECT src AS node, community, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, community) AS r FROM e JOIN l{i} ON e.dst = l{i}.node GROUP BY src, community) WHERE r = 1)"""
    return out + f" SELECT node, community FROM l{rounds}"


def _ranks_sql(rounds: int, damping: float) -> str:
    out = f"WITH e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({TREE})), o AS MATERIALIZED (SELECT src, count(*) AS c FROM e GROUP BY 1), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v), r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM v, n)"
    for i in range(rounds):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT x.node, {1 - damping} / n + {damping} * (coalesce(got, 0) + lost / n) AS rank FROM r{i} x CROSS JOIN n
          CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM o)) LEFT JOIN (SELECT dst, sum(rank / c) AS got FROM e JOIN o USING (src) JOIN r{i} ON e.src = r{i}.node GROUP BY dst) g ON g.dst = x.node)"""
    return out + f" SELECT node, round(rank, 10) AS rank FROM r{rounds}"


@q("GR-18", oracle=_labels_sql(20))
def gr_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return g.label_propagation(tree(spark, d), 20, cut)


@q("GR-20", oracle="""
WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem), s AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM s GROUP BY node""")
def gr_degree(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    return g.degrees(g.distinct_edges(e))


@q("GR-21", oracle=_ranks_sql(10, 0.85))
def gr_pagerank(spark: SparkSession, d: str) -> DataFrame:
    r = g.pagerank(tree(spark, d), 10, 0.85, cut)
    return r.select("node", F.round("rank", 10).alias("rank"))


@q("GR-21", oracle=f"""
WITH RECURSIVE e AS ({RING}), w AS (SELECT s_suppkey AS start, s_suppkey AS node FROM supplier UNION SELECT start, e.dst FROM w JOIN e ON w.node = e.src)
SELECT a.start AS node, min(a.node) AS component FROM w a JOIN w b ON a.start = b.node AND a.node = b.start WHERE a.start IN (SELECT src FROM e WHERE src <> dst UNION SELECT dst FROM e WHERE src <> dst) GROUP BY a.start""")
def gr_strong_components(spark: SparkSession, d: str) -> DataFrame:
    return g.strong_components(ring(spark, d), cut)


@q("GR-21", oracle=f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT p_partkey AS s, p_partkey AS node, 0 AS d FROM part UNION ALL SELECT s, e.dst, d + 1 FROM w JOIN e ON w.node = e.src), l AS (SELECT s, max(d) AS l FROM w GROUP BY 1),
b AS (SELECT node, CAST(sum(l - d) AS DOUBLE) AS score FROM w JOIN l USING (s) WHERE d >= 1 AND d < l GROUP BY node)
SELECT p_partkey AS node, coalesce(score, 0) AS score FROM part LEFT JOIN b ON p_partkey = node""")
def gr_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Exact betweenness of all parts in the tree."""
    return g.betweenness(tree(spark, d), cut)


@q("GR-22", oracle="""
SELECT c_custkey, s_suppkey, count(*) AS links FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey GROUP BY 1, 2""")
def gr_chain(spark: SparkSession, d: str) -> DataFrame:
    j = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.filter("c_nationkey = s_nationkey").groupBy("c_custkey", "s_suppkey").agg(F.count("*").alias("links"))


@q("GR-26", oracle=f"SELECT (SELECT count(*) FROM ({TREE})) AS edges, (SELECT count(*) FROM part) AS nodes, EXISTS (SELECT 1 FROM ({TREE}) WHERE src = 10 AND dst = 3) AS has_edge")
def gr_counts(spark: SparkSession, d: str) -> DataFrame:
    e = tree(spark, d)
    c = e.agg(F.count("*").alias("edges"), F.coalesce(F.bool_or((F.col("src") == 10) & (F.col("dst") == 3)), F.lit(False)).alias("has_edge"))
    return c.crossJoin(load(spark, d, "part").agg(F.count("*").alias("nodes"))).select("edges", "nodes", "has_edge")


# --- people ---------------------------------------------------------------------------------------

AS_OF = 978307200
TOUCH = "SELECT l_suppkey AS author, l_partkey AS module, CAST(epoch(l_shipdate) AS BIGINT) AS ts FROM lineitem"
MAINTAINS = f"""
  SELECT author, module, n, total, last, CAST(floor(({AS_OF} - last) / 86400) AS BIGINT) AS days FROM (
    SELECT author, module, count(*) AS n, max(ts) AS last, sum(count(*)) OVER (PARTITION BY module) AS total FROM ({TOUCH}) GROUP BY 1, 2) WHERE n >= 3 OR n / total >= 0.2"""


def touches(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("module"), rounded_seconds("l_shipdate").alias("ts"))


@q("SCR-01", "AG-13", "PL-12", oracle=f"""
SELECT author, module, n AS commits, round(0.6 * least(n / total, 1) + 0.4 * CASE WHEN days <= 0 THEN 1.0 WHEN days >= 365 THEN 0.1 ELSE 1 - days / 365 * 0.9 END, 3) AS score FROM ({MAINTAINS})""")
def ppl_maintains(spark: SparkSession, d: str) -> DataFrame:
    return people.maintains(touches(spark, d), "author", "module", "ts", AS_OF).select("author", "module", "commits", "score")


@q("GR-24", oracle=f"""
SELECT module, count(DISTINCT author) AS experts, CASE WHEN count(DISTINCT author) <= 1 THEN 'critical' WHEN count(DISTINCT author) = 2 THEN 'at_risk' ELSE 'covered' END AS status FROM ({MAINTAINS}) GROUP BY 1""")
def ppl_bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return people.bus_factor(people.maintains(touches(spark, d), "author", "module", "ts", AS_OF), "author", "module")


@q("GR-23", oracle=f"""
WITH m AS ({MAINTAINS}) SELECT a.author AS a, b.author AS b, count(*) AS shared, CASE WHEN count(*) >= 5 THEN 'strong' WHEN count(*) >= 2 THEN 'medium' ELSE 'weak' END AS strength FROM m a JOIN m b ON a.module = b.module AND a.author < b.author GROUP BY 1, 2""")
def ppl_collaboration(spark: SparkSession, d: str) -> DataFrame:
    return people.collaborators(people.maintains(touches(spark, d), "author", "module", "ts", AS_OF), "author", "module")


@q("SCR-02", "SCR-03", "PL-13", oracle=f"""
WITH m AS ({MAINTAINS}),
g AS (SELECT module, count(*) AS maintainers, count(*) FILTER ({AS_OF} - last <= 180 * 86400) AS active FROM m GROUP BY 1),
r AS (
  SELECT *, CASE maintainers WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 30 ELSE 0 END
            + CASE WHEN active = 0 THEN 50 WHEN active < maintainers THEN 20 ELSE 0 END AS risk
  FROM (SELECT p_partkey AS module, coalesce(maintainers, 0) AS maintainers, coalesce(active, 0) AS active FROM part LEFT JOIN g ON p_partkey = module)
)
SELECT module, maintainers, active, risk, CASE WHEN risk >= 100 THEN 'CRITICAL' WHEN risk >= 70 THEN 'HIGH' WHEN risk >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def ppl_risk(spark: SparkSession, d: str) -> DataFrame:
    """All modules, those that nobody maintains included."""
    m = people.maintains(touches(spark, d), "author", "module", "ts", AS_OF)
    g_ = m.groupBy("module").agg(F.count("*").alias("maintainers"), F.count_if(people.is_active(F.col("last"), AS_OF)).alias("active"))
    every = load(spark, d, "part").select(F.col("p_partkey").alias("module")).join(g_, "module", "left").fillna(0, ["maintainers", "active"])
    r = every.withColumn("risk", people.risk(F.col("maintainers"), F.col("active")))
    return r.select("module", "maintainers", "active", "risk", people.risk_level(F.col("risk")).alias("level"))


@q("PL-13", "WN-02", oracle=f"""
WITH m AS ({MAINTAINS}), s AS (SELECT a.author AS a, b.author AS b, count(*) AS shared FROM m a JOIN m b ON a.module = b.module AND a.author <> b.author GROUP BY 1, 2)
SELECT a, b, shared, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS r FROM s) WHERE r <= 3""")
def ppl_backups(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.text import top_per

    c = people.collaborators(people.maintains(touches(spark, d), "author", "module", "ts", AS_OF), "author", "module").select("a", "b", "shared")
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    return top_per(both, ["a"], "shared", ["b"], 3).select("a", "b", "shared", "rank")


@q("EXT-25", "EXT-26", oracle="""
SELECT c_custkey, c_name AS name, lower(replace(c_name, '#', '.')) || '@mail.example.com' AS email, trim(regexp_replace(lower(replace(c_name, '#', '.')), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM customer""")
def ppl_parse_authors(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" <"), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@mail.example.com>")).alias("s"))
    c = c.withColumn("a", people.parse_author(F.col("s")))
    return c.select("c_custkey", "a.name", "a.email", people.email_key(F.col("a.email")).alias("key"))
