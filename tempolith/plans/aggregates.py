"""Grouping, ranking and running computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import resolve
from ..registry import CORE
from ..tables import load, rounded_seconds

q = CORE.query


@q("AG-01", "AG-06", oracle="SELECT DISTINCT p_brand, p_size FROM part")
def agg_keys(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).select("p_brand", "p_size")


@q("AG-02", oracle="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count_into(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@q("AG-03", oracle="""
SELECT p_brand, count(*) AS n, string_agg(p_name, ',' ORDER BY p_partkey) FILTER (p_size > 45) AS names, min_by(p_partkey, p_retailprice * 1000000 + p_partkey) AS cheapest FROM part GROUP BY p_brand""")
def agg_into_groups(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.when(F.col("p_size") > 45, F.struct("p_partkey", "p_name")))).alias("docs"), F.count("*").alias("n"), F.min_by("p_partkey", F.col("p_retailprice") * 1000000 + F.col("p_partkey")).alias("cheapest"))
    return g.select("p_brand", "n", F.when(F.size("docs") > 0, F.array_join(F.transform("docs", lambda x: x.p_name), ",")).alias("names"), "cheapest")


@q("AG-04", "AG-19", oracle="""
SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total, round(avg(o_totalprice), 4) AS mean,
       round(stddev_pop(o_totalprice), 4) AS sd_pop, round(stddev_samp(o_totalprice), 4) AS sd_samp, round(var_pop(o_totalprice) / 1e6, 4) AS var_pop, round(var_samp(o_totalprice) / 1e6, 4) AS var_samp,
       count(*) AS n, count(DISTINCT o_custkey) AS custs, bit_and(o_orderkey | 15) AS b_and, bit_or(o_orderkey) AS b_or, bit_xor(o_orderkey) AS b_xor,
       array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states
FROM orders GROUP BY o_orderpriority""")
def agg_collect_full(spark: SparkSession, d: str) -> DataFrame:
    p = "o_totalprice"
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.min(p).alias("lo"), F.max(p).alias("hi"), F.round(F.sum(p), 2).alias("total"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_pop(p), 4).alias("sd_pop"),
        F.round(F.stddev_samp(p), 4).alias("sd_samp"), F.round(F.var_pop(p) / 1e6, 4).alias("var_pop"), F.round(F.var_samp(p) / 1e6, 4).alias("var_samp"), F.count("*").alias("n"), F.countDistinct("o_custkey").alias("custs"),
        F.bit_and(F.col("o_orderkey").bitwiseOR(F.lit(15))).alias("b_and"), F.bit_or("o_orderkey").alias("b_or"), F.bit_xor("o_orderkey").alias("b_xor"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("states"),
    )


@q("AG-05", oracle="SELECT count(*) AS n, max(l_quantity) AS hi, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").agg(F.count("*").alias("n"), F.max("l_quantity").alias("hi"), F.countDistinct("l_partkey").alias("parts"))


@q("AG-07", "PL-14", oracle="SELECT CAST(floor(l_discount * 100) AS BIGINT) AS bucket, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def agg_buckets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.floor(F.col("l_discount") * 100).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@q("AG-08", oracle="""
WITH a AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(list_avg(v), 7) AS mean, round(list_median(v), 6) AS med, round(list_sum(v), 2) AS total, list_max(v) AS hi, round(list_var_pop(v) / 1e6, 4) AS var FROM a""")
def agg_array(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import arrays as A

    a = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    v = F.col("v")
    return a.select("o_custkey", F.round(A.average(v), 7).alias("mean"), F.round(A.median(v), 6).alias("med"), F.round(A.total(v), 2).alias("total"), F.array_max(v).alias("hi"), F.round(A.variance(v) / 1e6, 4).alias("var"))


@q("AG-09", "PL-01", oracle="""
WITH r AS (SELECT *, lower(trim(p_name)) AS norm, row_number() OVER (PARTITION BY p_brand, lower(trim(p_name)) ORDER BY length(p_name) DESC, p_partkey) AS k FROM part)
SELECT p_brand, norm, max(p_partkey) FILTER (k = 1) AS primary_key, max(p_name) FILTER (k = 1) AS name, count(*) AS members, array_to_string(list_sort(list(DISTINCT p_type)), ' | ') AS description FROM r GROUP BY p_brand, norm""")
def agg_elect(spark: SparkSession, d: str) -> DataFrame:
    return resolve.elect(load(spark, d, "part"), "p_brand", "p_name", "p_partkey", "p_type").select("p_brand", "norm", "primary_key", "name", "members", "description")


@q("AG-10", oracle="""
SELECT lower(trim(p_name)) AS norm, min_by(p_type, p_partkey) FILTER (p_type LIKE '%PROMO%') AS description, count(*) AS members, min(p_size) AS first_seen, max(p_size) AS last_seen, min(p_partkey) AS primary_key,
       array_to_string(list_distinct_ordered, ',') AS sources FROM (
  SELECT *, (SELECT list(b ORDER BY f) FROM (SELECT p2.p_brand AS b, min(p2.p_partkey) AS f FROM part p2 WHERE lower(trim(p2.p_name)) = lower(trim(part.p_name)) GROUP BY 1)) AS list_distinct_ordered FROM part) GROUP BY norm, list_distinct_ordered""")
def agg_golden(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").withColumn("description", F.when(F.col("p_type").contains("PROMO"), F.col("p_type")).otherwise(""))
    g = resolve.golden(p, "p_partkey", "p_name", "p_partkey", "description", "p_size", "p_brand")
    return g.select("norm", "description", "members", "first_seen", "last_seen", "primary_key", F.array_join("sources", ",").alias("sources"))


@q("AG-11", oracle="""
WITH m AS (SELECT p_partkey AS raw, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS golden FROM part), e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber)
SELECT x.golden AS src, y.golden AS dst, 'NEXT' AS type, count(*) AS evidence FROM e JOIN m x ON e.src = x.raw JOIN m y ON e.dst = y.raw WHERE x.golden <> y.golden GROUP BY 1, 2""")
def agg_repoint(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "part").select(F.col("p_partkey").alias("raw"), F.min("p_partkey").over(Window.partitionBy("p_brand", "p_name")).alias("golden"))
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    e = li.withColumn("l_linenumber", F.col("l_linenumber") + 1).withColumnRenamed("l_partkey", "src").join(li.withColumnRenamed("l_partkey", "dst"), ["l_orderkey", "l_linenumber"]).select("src", "dst", F.lit("NEXT").alias("type"))
    return resolve.repoint(e, m, "src", "dst", "type")


@q("AG-13", "WN-08", oracle="""
SELECT l_suppkey, l_partkey, n, round(n / total, 6) AS share, n >= 3 OR n / total >= 0.2 AS qualifies FROM (
  SELECT l_suppkey, l_partkey, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_partkey) AS total FROM lineitem GROUP BY 1, 2)""")
def agg_share(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("l_partkey")))
    return g.select("l_suppkey", "l_partkey", "n", F.round("share", 6).alias("share"), ((F.col("n") >= 3) | (F.col("share") >= 0.2)).alias("qualifies"))


@q("AG-14", oracle="""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, arg_min(p_type, -n * 100000000 + rank_) AS dominant FROM (SELECT *, row_number() OVER (ORDER BY p_type) AS rank_ FROM c) GROUP BY p_brand""")
def agg_dominant(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return c.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("v"), "p_type"))["p_type"].alias("dominant"))


@q("AG-15", oracle="""
SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (value > 50) / count(*), 2) AS coverage FROM events GROUP BY event_type""")
def agg_coverage(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.count_if(F.col("value") > 50) / F.count("*"), 2).alias("coverage"))


@q("AG-16", oracle="""
WITH p AS (SELECT toxic = 1 AS truth, regexp_matches(text, 'idiot|moron|scum') AS guess FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn FROM p)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def agg_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.quality import precision_recall

    p = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select((F.col("toxic") == 1).alias("truth"), F.col("text").rlike("idiot|moron|scum").alias("guess"))
    return precision_recall(p, "truth", "guess")


@q("AG-17", oracle="""
SELECT year(o_orderdate) AS epoch, count(*) AS n, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS examples FROM orders GROUP BY 1""")
def agg_epoch_examples(spark: SparkSession, d: str) -> DataFrame:
    """Three smallest keys by rank, not by collecting all."""
    w = Window.partitionBy("epoch").orderBy("o_orderkey")
    o = load(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("epoch"), "o_orderkey")
    few = o.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("epoch").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("examples"))
    return o.groupBy("epoch").agg(F.count("*").alias("n")).join(few, "epoch")


@q("AG-18", oracle="""
SELECT 'nation' AS collection, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def agg_collection_stats(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.quality import collection_stats

    return collection_stats({n: load(spark, d, n) for n in ("nation", "region", "supplier")}).select("collection", "n")


@q("AG-20", oracle="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@q("AG-19", oracle="SELECT true AS close_enough")
def agg_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("e"))
    return a.select((F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("close_enough"))


# --- windows ------------------------------------------------------------------------------------


@q("WN-01", oracle="""
SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def win_top1(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return load(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).filter("r = 1").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@q("WN-02", oracle="""
SELECT n_name, c_custkey, CAST(r AS INTEGER) AS r FROM (SELECT n_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 3""")
def win_topk(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = load(spark, d, "customer").withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return c.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "r")


@q("WN-03", oracle="""
SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS valid_from_ts, coalesce(lead(CAST(epoch(o_orderdate) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 9999999999) AS valid_to_ts FROM orders""")
def win_lead_close(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.temporal import close_intervals

    o = load(spark, d, "orders").withColumn("ts", rounded_seconds("o_orderdate"))
    return close_intervals(o, ["o_custkey"], "ts", ["o_orderkey"]).select("o_custkey", "o_orderkey", "valid_from_ts", "valid_to_ts")


@q("WN-04", oracle="""
WITH e AS (SELECT c_mktsegment AS repo, year(o_orderdate) AS epoch, min(CAST(epoch(o_orderdate) AS BIGINT)) AS start_ts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT repo, epoch, start_ts, lead(start_ts) OVER (PARTITION BY repo ORDER BY start_ts) AS end_ts FROM e""")
def win_epoch_end(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = o.groupBy(F.col("c_mktsegment").alias("repo"), F.year("o_orderdate").cast("long").alias("epoch")).agg(F.min(rounded_seconds("o_orderdate")).alias("start_ts"))
    return e.withColumn("end_ts", F.lead("start_ts").over(Window.partitionBy("repo").orderBy("start_ts")))


@q("WN-06", oracle="""
SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS src, o_orderkey AS dst FROM orders QUALIFY src IS NOT NULL""")
def win_timeline(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, d, "orders").select("o_custkey", F.lag("o_orderkey").over(w).alias("src"), F.col("o_orderkey").alias("dst")).filter("src IS NOT NULL")


@q("WN-07", oracle="""
SELECT l_partkey, l_suppkey, round(score, 6) AS score, round(score - coalesce(nxt, 0), 6) AS margin FROM (
  SELECT l_partkey, l_suppkey, score, lead(score) OVER w AS nxt, row_number() OVER w AS r FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) / 500 AS score FROM lineitem GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey)) WHERE r = 1 AND score >= 0.1""")
def win_second_best(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg((F.sum("l_quantity") / 500).alias("score"))
    return resolve.best_match(c, "l_partkey", "score", ["l_suppkey"], 0.1).select("l_partkey", "l_suppkey", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@q("WN-09", oracle="""
SELECT o_custkey, v[len(v) // 2 + 1] AS middle FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders GROUP BY 1)""")
def win_middle(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    o = load(spark, d, "orders").withColumn("r", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))).withColumn("n", F.count("*").over(w))
    return o.filter(F.col("r") == F.floor(F.col("n") / 2) + 1).select("o_custkey", F.col("o_orderkey").alias("middle"))


@q("WN-10", oracle="""
SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT) RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS burst FROM events""")
def win_burst(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(rounded_seconds("ts")).rangeBetween(-604800, 0)
    return load(spark, d, "events").select("user_id", "event_id", F.count("*").over(w).alias("burst"))
