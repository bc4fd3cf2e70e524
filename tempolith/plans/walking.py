"""Walks with options, communities and approximate vector search, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann, leiden, walks
from ..registry import CORE
from ..sources.shared import scratch
from ..tables import load
from .graph import cut, start, tree
from .linking import _WALKS, halves

q = CORE.query

#: Two edge collections, with parallel edges among small parts: p on p div 3, and p beside p div 2.
TWO = """SELECT 2 * p_partkey AS edge, p_partkey AS src, p_partkey // 3 AS dst, 'DEPENDS_ON' AS type, CAST(1 + p_partkey % 3 AS DOUBLE) AS w FROM part WHERE p_partkey > 0
UNION ALL SELECT 2 * p_partkey + 1, p_partkey, p_partkey // 2, 'BESIDE', CAST(1 + p_partkey % 5 AS DOUBLE) FROM part WHERE p_partkey > 0"""


def two(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"))
    one = p.select((2 * F.col("src")).alias("edge"), "src", F.floor(F.col("src") / 3).alias("dst"), F.lit("DEPENDS_ON").alias("type"), (1 + F.col("src") % 3).cast("double").alias("w"))
    return one.unionByName(p.select((2 * F.col("src") + 1).alias("edge"), "src", F.floor(F.col("src") / 2).alias("dst"), F.lit("BESIDE").alias("type"), (1 + F.col("src") % 5).cast("double").alias("w")))


def _lines(w: DataFrame) -> DataFrame:
    line = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ">")
    return w.withColumn("path", line("path")).withColumn("edges", line("edges"))


def _walk_sql(e: str, starts: str, high: int, more: str = "") -> str:
    return f"""WITH RECURSIVE t AS ({TWO}), e AS ({e}), w AS (
  SELECT s AS start, s AS node, 0 AS depth, 0.0::DOUBLE AS cost, [s] AS path, []::BIGINT[] AS edges FROM (VALUES {starts}) v(s)
  UNION ALL SELECT start, e.dst, depth + 1, cost + e.w, list_append(path, e.dst), list_append(edges, e.edge) FROM w JOIN e ON w.node = e.src WHERE depth < {high} AND NOT list_contains(edges, e.edge) {more})"""


_ANY = "SELECT edge, src, dst, w FROM t UNION ALL SELECT edge, dst, src, w FROM t WHERE src <> dst"
_OUT = "start, node, CAST(depth AS INTEGER) AS depth, cost, array_to_string(path, '>') AS path, array_to_string(edges, '>') AS edges"


@q("GR-03", oracle=_walk_sql(_ANY, "(7::BIGINT), (40)", 3) + f" SELECT {_OUT} FROM w WHERE depth >= 1")
def gr_unique_edges(spark: SparkSession, d: str) -> DataFrame:
    """Walks in any direction on which no edge repeats, though vertices may; parallel edges are different ones."""
    return _lines(walks.walks(start(spark, 7, 40), two(spark, d), 1, 3, "any", weight="w"))


@q("GR-08", "GR-03", oracle=_walk_sql("SELECT edge, src, dst, w FROM t WHERE type = 'DEPENDS_ON' AND dst % 5 <> 0 UNION ALL SELECT edge, dst, src, w FROM t WHERE type = 'BESIDE' AND src % 5 <> 0", "(9::BIGINT), (41)", 4, "AND NOT list_contains(path, e.dst)") + f" SELECT {_OUT} FROM w WHERE depth >= 2")
def gr_directions(spark: SparkSession, d: str) -> DataFrame:
    """One collection outbound, the other inbound, within vertices of a kind, none of which repeats."""
    some = load(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("node"))
    return _lines(walks.walks(start(spark, 9, 41), two(spark, d), 2, 4, {"DEPENDS_ON": "outbound", "BESIDE": "inbound"}, unique_vertices="path", weight="w", order="dfs", vertices=some))


@q("GR-04", oracle=_walk_sql(_ANY, "(50::BIGINT)", 4) + """, b AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY cost, depth, path, edges) AS r FROM w)
SELECT start, node, CAST(depth AS INTEGER) AS depth, cost, array_to_string(path, '>') AS path, array_to_string(edges, '>') AS edges FROM b WHERE r = 1 AND depth >= 1""")
def gr_weighted_order(spark: SparkSession, d: str) -> DataFrame:
    """Every vertex once, by the cheapest walk of four edges at most, cheapest first."""
    return _lines(walks.walks(start(spark, 50), two(spark, d), 1, 4, "any", unique_vertices="global", weight="w", order="weighted"))


@q("GR-04", "GR-09", oracle=_WALKS + " SELECT (SELECT max(p_partkey) FROM part) AS start, node, min(cost) AS cost FROM p GROUP BY node")
def gr_cheapest(spark: SparkSession, d: str) -> DataFrame:
    """The least cost from the last part to each one that it reaches."""
    e, last = halves(spark, d)
    return walks.cheapest(start(spark, last), e.withColumn("type", F.lit("HALF")), "w", 4.0, cut)


@q("GR-25", oracle=_walk_sql(_ANY, "(7::BIGINT), (40)", 2) + """, n AS (SELECT DISTINCT unnest(path) AS n FROM w WHERE depth >= 1), k AS (SELECT DISTINCT unnest(edges) AS edge FROM w WHERE depth >= 1)
SELECT (SELECT CAST(to_json(list(n ORDER BY n)) AS VARCHAR) FROM n) AS nodes, (SELECT CAST(to_json(list({'edge': edge, 'src': src, 'dst': dst, 'type': type} ORDER BY edge)) AS VARCHAR) FROM k JOIN t USING (edge)) AS edges""")
def gr_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The vertices and edges of some walks, as one row of JSON to display."""
    e = two(spark, d)
    return walks.subgraph(walks.walks(start(spark, 7, 40), e, 1, 2, "any", keep=cut), e)


@q("GR-19", "PL-09")
def gr_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the parts, by the Leiden method."""
    return leiden.leiden(tree(spark, d), cut)


@q("VEC-01", "VEC-02")
def vec_approximate(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one by cosine, from an inverted file with product codes."""
    e = load(spark, d, "embeddings")
    n = e.count()
    quantizer = ann.fit(e, "vec_id", "embedding", lists=max(4, min(1024, int(n**0.5))))
    index = ann.build(e, "vec_id", "embedding", quantizer, scratch(spark, "vector-index"))
    found = ann.near(index, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, probes=max(4, int(n**0.5) // 4))
    return found.select("query", "key", F.round("score", 6).alias("score"), "rank")
