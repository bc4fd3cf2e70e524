"""Scans, projections, filters, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..registry import CORE
from ..tables import load, rounded_seconds

q = CORE.query


@q("SRC-01", "SRC-02", "JN-04", oracle="SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (1, 7, 33, 100, 512)")
def scan_document_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").filter(F.col("o_orderkey").isin(1, 7, 33, 100, 512))
    return o.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@q("PRJ-01", "PRJ-03", "PRJ-04", oracle="""
SELECT s_suppkey, s_name AS name, s_acctbal * 2 AS twice, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def prj_object(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").filter("s_acctbal > 0").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    doc = s.select(F.struct("s_suppkey", F.col("s_name").alias("name"), F.struct((F.col("s_acctbal") * 2).alias("twice"), F.col("n_name").alias("nation")).alias("sub")).alias("doc"))
    return doc.select("doc.s_suppkey", "doc.name", "doc.sub.twice", "doc.sub.nation")


@q("PRJ-02", oracle="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def prj_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@q("PRJ-05", oracle="SELECT n_nationkey, n_name, 'geo' AS layer, n_regionkey * 10 AS n_regionkey FROM nation")
def prj_merge_keep_unset(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select(F.struct("*", F.lit(1).alias("tmp")).alias("doc"))
    merged = F.col("doc").withField("layer", F.lit("geo")).withField("n_regionkey", F.col("doc.n_regionkey") * 10).dropFields("tmp")
    return n.select(merged.alias("doc")).select("doc.*")


@q("PRJ-06", "FLT-05", oracle="""
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS bin, coalesce(nullif(p_size % 3, 0), -1) AS fallback FROM part""")
def prj_ternary(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.values import either, truthy_number

    r = F.col("p_size") % 3
    return load(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("bin"), either(r, F.lit(-1), truthy_number).alias("fallback"))


@q("FLT-01", "FLT-02", "FLT-03", "FLT-12", oracle="""
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate::DATE::VARCHAR AS day FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_discount <> 0.05 AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_extendedprice < 50000""")
def flt_predicates(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    return li.filter(
        F.col("l_quantity").between(10, 20) & (F.col("l_discount") != 0.05) & F.col("l_returnflag").isin("A", "R")
        & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_extendedprice") < 50000)
    ).select("l_orderkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))


@q("FLT-03", "FLT-08", oracle="""
SELECT p_partkey, p_name FROM part WHERE (p_name LIKE '%a%e%' AND NOT regexp_matches(p_name, '^[m-z]')) OR starts_with(p_name, 'b') OR contains(lower(p_type), 'promo')""")
def flt_patterns(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return load(spark, d, "part").filter((n.like("%a%e%") & ~n.rlike("^[m-z]")) | n.startswith("b") | F.contains(F.lower("p_type"), F.lit("promo"))).select("p_partkey", "p_name")


@q("FLT-04", "FLT-11", oracle="""
WITH a AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT)) AS qs FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(list_filter(qs, lambda x: x >= 10)) = len(qs) AS all_10, len(list_filter(qs, lambda x: x > 45)) > 0 AS any_45,
       len(list_filter(qs, lambda x: x < 3)) = 0 AS none_3, len(list_filter(qs, lambda x: x > 25)) >= 2 AS two_25, list_contains(qs, 17) AS has_17 FROM a""")
def flt_quantifiers(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("long")).alias("qs"))
    c = F.col("qs")
    return a.select(
        "l_orderkey", rel.all_of(c, lambda x: x >= 10).alias("all_10"), rel.any_of(c, lambda x: x > 45).alias("any_45"),
        rel.none_of(c, lambda x: x < 3).alias("none_3"), rel.at_least(2, c, lambda x: x > 25).alias("two_25"), F.array_contains("qs", 17).alias("has_17"),
    )


@q("FLT-06", "FLT-02", oracle="""
SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey WHERE o_custkey IS NULL AND c_acctbal IS NOT NULL""")
def flt_null_not_in(spark: SparkSession, d: str) -> DataFrame:
    big = load(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").filter("c_acctbal IS NOT NULL").join(big, "c_custkey", "left_anti").select("c_custkey")


@q("FLT-07", "GR-08", oracle="""
SELECT id, kind FROM (SELECT 'nation/' || n_nationkey AS id, 'nation' AS kind FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'region' FROM region) WHERE split_part(id, '/', 1) = 'region'""")
def flt_same_collection(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "nation").select(F.concat_ws("/", F.lit("nation"), "n_nationkey").alias("id"), F.lit("nation").alias("kind"))
    ids = ids.unionByName(load(spark, d, "region").select(F.concat_ws("/", F.lit("region"), "r_regionkey").alias("id"), F.lit("region").alias("kind")))
    return ids.filter(F.split_part("id", F.lit("/"), F.lit(1)) == "region")


#: Which part types may stand for which: fixed test values.
COMPATIBLE = [("LARGE", "MEDIUM"), ("LARGE", "LARGE"), ("PROMO", "PROMO"), ("SMALL", "STANDARD"), ("STANDARD", "SMALL")]
STOP_NAMES = ["none", "lemon"]


@q("FLT-09", "FLT-10", oracle=f"""
WITH t AS (SELECT p_partkey, split_part(p_type, ' ', -1) AS metal, p_brand, p_name FROM part WHERE p_name NOT IN ('none', 'lemon')), c AS (SELECT * FROM (VALUES {', '.join(map(str, COMPATIBLE))}) v(a, b))
SELECT a.metal AS source_type, b.metal AS candidate_type, count(*) AS pairs FROM t a JOIN c ON a.metal = c.a JOIN t b ON b.metal = c.b AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey GROUP BY ALL""")
def flt_type_matrix(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "part").filter(~F.col("p_name").isin(STOP_NAMES)).select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(-1)).alias("metal"), "p_brand")
    c = F.broadcast(spark.createDataFrame(COMPATIBLE, "source_type string, candidate_type string"))
    group = ["source_type", "candidate_type", "p_brand"]
    a = t.withColumnRenamed("metal", "source_type").join(c, "source_type").select(*group, "p_partkey", F.lit(1).alias("first"), F.lit(0).alias("second"))
    b = t.withColumnRenamed("metal", "candidate_type").join(c, "candidate_type").select(*group, "p_partkey", F.lit(0).alias("first"), F.lit(1).alias("second"))
    n = rel.ordered_pairs(a.unionByName(b).filter("p_brand IS NOT NULL"), group, "p_partkey", "first", "second")
    return n.groupBy("source_type", "candidate_type").agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")


# --- joins --------------------------------------------------------------------------------------


@q("JN-01", "AG-02", oracle="SELECT n_name, count(*) AS n_orders, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def jn_inner(spark: SparkSession, d: str) -> DataFrame:
    j = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("JN-02", oracle="SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 10")
def jn_cartesian(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "region").crossJoin(load(spark, d, "nation").filter("n_nationkey < 10")).select("r_name", "n_name")


@q("JN-03", oracle="""
SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def jn_left_collect(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    j = rel.left_collect(load(spark, d, "customer").select("c_custkey"), o, "c_custkey", ["o_orderkey", "o_totalprice"], "orders", ["o_orderkey"])
    return j.select("c_custkey", F.array_join(F.transform("orders", lambda x: x.o_orderkey.cast("string")), ",").alias("orders"), F.size("orders").cast("long").alias("n"))


@q("JN-05", "JN-14", oracle="SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def jn_semi(spark: SparkSession, d: str) -> DataFrame:
    big = load(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return load(spark, d, "supplier").join(big, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@q("JN-06", oracle="SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def jn_anti(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").join(load(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@q("JN-07", oracle="""
WITH n AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT a.p_brand, a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.k < b.k
WHERE abs(length(a.p_name) - length(b.p_name)) <= 3 AND levenshtein(a.p_name, b.p_name) <= 3""")
def jn_theta_blocked(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.resolve import fuzzy_blocks

    n = load(spark, d, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("k"))
    return fuzzy_blocks(n, "p_brand", "p_name", "k", 3).select("p_brand", "a", "b", "distance")


EPOCHS_SQL = """
  SELECT c_mktsegment AS repo, year(o_orderdate) AS y, CAST(epoch(date_trunc('year', min(o_orderdate))) AS BIGINT) AS e_from,
         CAST(epoch(date_trunc('year', min(o_orderdate)) + INTERVAL 1 YEAR) AS BIGINT) AS e_to
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


@q("JN-08", "TM-03", oracle=f"""
WITH e AS ({EPOCHS_SQL}), v AS (
  SELECT c_mktsegment AS repo, o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS v_from,
         coalesce(lead(CAST(epoch(o_orderdate) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 9999999999) AS v_to
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT repo, y, count(*) AS live, count(DISTINCT o_custkey) AS owners FROM e JOIN v USING (repo) WHERE v_from < e_to AND v_to > e_from AND v_to > v_from GROUP BY repo, y""")
def jn_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.temporal import close_intervals

    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("repo"), "o_custkey", "o_orderkey", "o_orderdate", rounded_seconds("o_orderdate").alias("ts"))
    start = F.date_trunc("year", F.col("o_orderdate").cast("timestamp"))
    e = o.groupBy("repo", F.year("o_orderdate").cast("long").alias("y")).agg(F.unix_seconds(F.min(start)).alias("e_from"), F.unix_seconds(F.min(start + F.expr("INTERVAL 1 YEAR"))).alias("e_to"))
    v = close_intervals(o, ["o_custkey"], "ts", ["o_orderkey"]).select("repo", "o_custkey", F.col("valid_from_ts").alias("v_from"), F.col("valid_to_ts").alias("v_to"))
    j = rel.interval_join(e, v, ["repo"], ("e_from", "e_to"), ("v_from", "v_to"), 366 * 86400)
    return j.groupBy("repo", "y").agg(F.count("*").alias("live"), F.countDistinct("o_custkey").alias("owners"))


@q("JN-09", oracle="""
WITH x AS (SELECT o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderkey FROM orders)
SELECT o_custkey, ts, abs(ts - 852076800) AS distance, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(ts - 852076800), ts, o_orderkey) AS r FROM x) WHERE r = 1""")
def jn_nearest(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_custkey", rounded_seconds("o_orderdate").alias("ts"), "o_orderkey")
    return rel.nearest(o, ["o_custkey"], "ts", 852076800, ["o_orderkey"])


@q("JN-10", oracle="""
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS vts, event_id AS view_id FROM events WHERE event_type = 'view')
SELECT event_id, user_id, view_id FROM (
  SELECT e.event_id, e.user_id, v.view_id, row_number() OVER (PARTITION BY e.event_id ORDER BY v.vts DESC NULLS LAST, v.view_id DESC NULLS LAST) AS r
  FROM e LEFT JOIN v ON e.user_id = v.user_id AND v.vts <= e.ts) WHERE r = 1""")
def jn_asof_previous(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    v = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), F.col("event_id").alias("view_id"))
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return rel.as_of_previous(p, v, ["user_id"], "ts", "vts", ["view_id"]).select("event_id", "user_id", "view_id")


REPO_MAP = [("AUTOMOBILE", "cars"), ("BUILDING", "bricks"), ("MACHINERY", "cars")]


@q("JN-11", "TM-15", oracle=f"""
SELECT m.repo, count(*) AS snapshots FROM customer JOIN (VALUES {', '.join(map(str, REPO_MAP))}) m(seg, repo) ON c_mktsegment = m.seg GROUP BY m.repo""")
def jn_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = F.broadcast(spark.createDataFrame(REPO_MAP, "c_mktsegment string, repo string"))
    return load(spark, d, "customer").join(m, "c_mktsegment").groupBy("repo").agg(F.count("*").alias("snapshots"))


@q("JN-13", oracle="""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33'))
SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_type = b.p_type THEN 'type' ELSE 'name' END AS how
FROM p a JOIN p b ON a.p_brand < b.p_brand AND (a.p_type = b.p_type AND a.p_name = b.p_name OR a.p_name = b.p_name)""")
def jn_label_or_hash(spark: SparkSession, d: str) -> DataFrame:
    """An OR of equalities as a union of equi-joins."""
    p = load(spark, d, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33")).select("p_partkey", "p_name", "p_brand", "p_type")
    b = p.select(*[F.col(c).alias(f"b_{c}") for c in p.columns])
    both = p.join(b, (F.col("p_name") == F.col("b_p_name")) & (F.col("p_type") == F.col("b_p_type"))).select("p_partkey", "b_p_partkey", "p_brand", "b_p_brand", F.lit("type").alias("how"))
    name = p.join(b, (F.col("p_name") == F.col("b_p_name")) & (F.col("p_type") != F.col("b_p_type"))).select("p_partkey", "b_p_partkey", "p_brand", "b_p_brand", F.lit("name").alias("how"))
    return both.unionByName(name).filter("p_brand < b_p_brand").select(F.col("p_partkey").alias("a"), F.col("b_p_partkey").alias("b"), "how")


@q("JN-15", oracle="""
SELECT e.l_orderkey, e.l_partkey, CASE WHEN o.o_orderkey IS NULL AND p.p_partkey IS NULL THEN 'both' WHEN o.o_orderkey IS NULL THEN 'from' ELSE 'to' END AS missing
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) e LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) o ON e.l_orderkey = o.o_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) p ON e.l_partkey = p.p_partkey
WHERE o.o_orderkey IS NULL OR p.p_partkey IS NULL""")
def jn_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Edges order -> part, where every tenth order and every seventh part is gone."""
    e = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    o = load(spark, d, "orders").filter("o_orderkey % 10 <> 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    n = o.unionByName(load(spark, d, "part").filter("p_partkey % 7 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    e = e.withColumns({"src": F.concat(F.lit("o"), "l_orderkey"), "dst": F.concat(F.lit("p"), "l_partkey")})
    return rel.dangling(e, n, "src", "dst", "id").select("l_orderkey", "l_partkey", "missing")


@q("JN-15", oracle="""
SELECT count(*) AS kept FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)""")
def jn_repaired(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    o = load(spark, d, "orders").filter("o_orderkey % 10 <> 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    n = o.unionByName(load(spark, d, "part").filter("p_partkey % 7 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    return rel.repaired(e, n, "src", "dst", "id").agg(F.count("*").alias("kept"))


@q("JN-16", oracle="SELECT node, count(*) AS degree FROM (SELECT l_suppkey AS node, l_partkey FROM lineitem UNION ALL SELECT l_partkey, l_suppkey FROM lineitem) GROUP BY node")
def jn_undirected(spark: SparkSession, d: str) -> DataFrame:
    return rel.neighbours_any(load(spark, d, "lineitem"), "l_suppkey", "l_partkey").groupBy("node").agg(F.count("*").alias("degree"))


# --- sorting and limits ---------------------------------------------------------------------------


@q("SL-01", "SL-02", "SL-05", oracle="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def sl_sort_offset(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").orderBy(F.asc_nulls_first("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25).select("o_orderkey", "o_totalprice")


@q("SL-03", "SL-04", oracle="SELECT o_orderkey, CAST(abs(epoch(o_orderdate) - 852076800) AS BIGINT) AS away FROM orders ORDER BY away, o_orderkey LIMIT 40")
def sl_topk_expr(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", F.abs(rounded_seconds("o_orderdate") - 852076800).alias("away")).orderBy("away", "o_orderkey").limit(40)


@q("SL-06", oracle="""
WITH u AS (SELECT p_name AS name, p_type AS kind, p_retailprice AS score, 1 AS src FROM part UNION ALL SELECT p_name, p_type, p_retailprice * 0.9, 2 FROM part WHERE p_size > 20),
r AS (SELECT *, row_number() OVER (PARTITION BY name, left(kind, 80) ORDER BY score DESC, src) AS k FROM u)
SELECT name, kind, CAST(round(score, 4) AS DOUBLE) AS score, src FROM r WHERE k = 1 ORDER BY r.score DESC, name, kind LIMIT 30""")
def sl_merge_dedup(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.retrieve import merge_ranked

    p = load(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("score"), F.lit(1).alias("src"), "p_size")
    b = p.filter("p_size > 20").withColumn("score", F.col("score") * 0.9).withColumn("src", F.lit(2))
    return merge_ranked([p.drop("p_size"), b.drop("p_size")], "name", "kind", "score", "src", 30).withColumn("score", F.round("score", 4))


# --- sets -----------------------------------------------------------------------------------------


def _custs(spark: SparkSession, d: str, p: str) -> DataFrame:
    return load(spark, d, "orders").filter(f"o_orderpriority = '{p}'").select("o_custkey")


@q("ST-01", "ST-02", oracle="""
SELECT 'bag' AS how, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
UNION ALL SELECT 'set', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    u = _custs(spark, d, "1-URGENT").unionByName(_custs(spark, d, "5-LOW"))
    return u.agg(F.count("*").alias("n")).select(F.lit("bag").alias("how"), "n").unionByName(u.distinct().agg(F.count("*").alias("n")).select(F.lit("set").alias("how"), "n"))


@q("ST-03", oracle="SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _custs(spark, d, "1-URGENT").intersect(_custs(spark, d, "5-LOW"))


@q("ST-04", oracle="SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def set_minus(spark: SparkSession, d: str) -> DataFrame:
    return _custs(spark, d, "1-URGENT").subtract(_custs(spark, d, "5-LOW"))


@q("ST-05", oracle="""
SELECT o_custkey FROM (SELECT DISTINCT o_custkey, 1 AS s FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT o_custkey, 2 FROM orders WHERE o_orderpriority = '5-LOW') GROUP BY o_custkey HAVING count(*) = 1""")
def set_outersection(spark: SparkSession, d: str) -> DataFrame:
    return rel.outersection(_custs(spark, d, "1-URGENT"), _custs(spark, d, "5-LOW"))


@q("ST-06", oracle="""
WITH b AS (SELECT l_partkey AS k, md5(string_agg(CAST(l_quantity AS INTEGER)::VARCHAR, ',' ORDER BY l_quantity)) AS h FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1),
a AS (SELECT l_partkey AS k, md5(string_agg(CAST(l_quantity AS INTEGER)::VARCHAR, ',' ORDER BY l_quantity)) AS h FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.k = b.k""")
def set_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity", "l_shipdate")
    digest = F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("l_quantity")), lambda x: x.cast("int").cast("string")), ",")).alias("h")
    t = F.lit("1995-01-01").cast("timestamp_ntz")
    return rel.snapshot_diff(li.filter(F.col("l_shipdate") < t).groupBy("k").agg(digest), li.filter(F.col("l_shipdate") >= t).groupBy("k").agg(digest), "k", "h")


@q("ST-07", oracle="""
WITH s AS (SELECT s_nationkey, list(DISTINCT l_partkey) AS parts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT a.s_nationkey AS a, b.s_nationkey AS b, CAST(round(len(list_intersect(a.parts, b.parts)) / len(list_distinct(list_concat(a.parts, b.parts))), 6) AS DOUBLE) AS jaccard FROM s a JOIN s b ON a.s_nationkey < b.s_nationkey""")
def set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """By an equi-join on the elements: what a pair shares is counted, and sizes give the rest."""
    e = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_partkey").distinct()
    n = e.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    b = e.select(F.col("s_nationkey").alias("b"), "l_partkey")
    shared = e.withColumnRenamed("s_nationkey", "a").join(b, "l_partkey").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = n.select(F.col("s_nationkey").alias("a"), F.col("n").alias("na")).join(n.select(F.col("s_nationkey").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    j = pairs.join(shared, ["a", "b"], "left")
    both = F.coalesce("both", F.lit(0))
    return j.select("a", "b", F.round(both / (F.col("na") + F.col("nb") - both), 6).alias("jaccard"))
