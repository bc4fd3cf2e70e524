"""Sources and sinks, round trips through files, keyed writes, and extractors on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import relational as rel
from ..registry import CORE
from ..sources import files
from ..tables import load, rounded_seconds
from ..sources.shared import scratch

q = CORE.query


@q("SRC-03", "SRC-04", "SRC-05", oracle="SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines among broken ones, and read again."""
    p = scratch(spark, "jsonl")
    s = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    files.write_jsonl(s, p)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(p)
    return files.read_jsonl(spark, p, "s_suppkey long, s_name string, s_acctbal double").filter("s_suppkey IS NOT NULL")


@q("SRC-06", oracle="SELECT n_nationkey, n_name FROM nation")
def src_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark, "csv")
    files.write_csv(load(spark, d, "nation").select("n_nationkey", "n_name"), p)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(p)


@q("SRC-17", "SRC-15", oracle="SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def src_collections(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark, "collections")
    files.write_collections(load(spark, d, "events").withColumnRenamed("event_type", "type"), p)
    files.write_collections(load(spark, d, "events").withColumnRenamed("event_type", "type"), p)  # replaces, doesn't add
    return spark.read.parquet(p).groupBy("type").agg(F.count("*").alias("n"))


@q("SRC-12", "SRC-14", oracle="""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier WHERE s_suppkey < 5""")
def src_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select("s_suppkey", "s_acctbal").withColumn("seq", F.lit(0))
    changed = s.filter("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1).unionByName(s.filter("s_suppkey < 5").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    p = scratch(spark, "upsert")
    s.write.parquet(p)
    return spark.read.parquet(files.upsert_table(spark, p, changed, "s_suppkey", "seq")).select("s_suppkey", "s_acctbal")


@q("SRC-13", oracle="""
SELECT 'ignore' AS mode, s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey < 20 UNION ALL SELECT 'ignore', s_suppkey, 'new' FROM supplier WHERE s_suppkey BETWEEN 20 AND 29
UNION ALL SELECT 'replace', s_suppkey, CASE WHEN s_suppkey >= 10 THEN 'new' ELSE s_name END FROM supplier WHERE s_suppkey < 30
UNION ALL SELECT 'update', s_suppkey, CASE WHEN s_suppkey >= 10 THEN 'new' ELSE s_name END FROM supplier WHERE s_suppkey < 30""")
def src_insert_modes(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    base, new = s.filter("k < 20"), s.filter("k BETWEEN 10 AND 29").withColumn("v", F.lit("new"))
    out = None
    for mode in ("ignore", "replace", "update"):
        one = rel.insert(base, new, "k", mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@q("SRC-14", oracle="SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def src_remove(spark: SparkSession, d: str) -> DataFrame:
    gone = load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.remove(load(spark, d, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@q("SRC-16", oracle="""
SELECT 'orders/' || l_orderkey AS "from", 'part/' || l_partkey AS "to", count(*) AS n FROM lineitem GROUP BY 1, 2""")
def src_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Order ids are in the id map, part ids fall back on the default of the edge type."""
    e = load(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("from"), F.col("l_partkey").cast("string").alias("to"), F.lit("HAS").alias("type"))
    ids = load(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("orders").alias("collection"))
    r = files.resolve_endpoints(e, ids, {"HAS": ("orders", "part")})
    return r.select(F.replace("from", F.lit("/o"), F.lit("/")).alias("from"), "to").groupBy("from", "to").agg(F.count("*").alias("n"))


@q("SRC-18", oracle="SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0")
def src_resume(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey")
    return rel.unseen(o, o.filter("o_orderkey % 4 = 0"), ["o_orderkey"])


@q("SRC-19", oracle="SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def src_copy(spark: SparkSession, d: str) -> DataFrame:
    a, b = scratch(spark, "copy-a"), scratch(spark, "copy-b")
    for n in ("nation", "region"):
        load(spark, d, n).write.parquet(f"{a}/{n}")
    files.copy_collections(spark, a, b, ["nation", "region"])
    c = lambda n: spark.read.parquet(f"{b}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n")
    return c("nation").unionByName(c("region"))


@q("SRC-10", oracle="SELECT o_orderkey AS commit, 'c' || o_custkey AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, 'a|||b ' || o_orderstatus AS subject FROM orders")
def src_commits(spark: SparkSession, d: str) -> DataFrame:
    """Log lines, of which the last field contains the separator."""
    sec = rounded_seconds("o_orderdate").cast("string")
    lines = load(spark, d, "orders").select(F.concat_ws("|||", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), "o_custkey"), F.lit("m@x"), sec, F.concat(F.lit("a|||b "), "o_orderstatus")).alias("value"))
    return files.parse_commits(lines).select(F.col("commit").cast("long").alias("commit"), "author", "ts", "subject")


# --- extractors on pages ------------------------------------------------------------------------------


@q("EXT-01", "EXT-05", oracle="""
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS l FROM pages), (SELECT unnest(range(1, 400)) AS i) WHERE i <= len(l)""")
def ext_links(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))).alias("pos", "href"))
    return p


@q("EXT-09", oracle="SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def ext_title(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


def source(spark: SparkSession, d: str) -> DataFrame:
    """A module of hardware description text for each supplier, made from its row."""
    t = F.format_string(
        "// Description: unit %d\nmodule unit_%d (\n  input clk, // clock\n  input [7:0] a,\n  output reg [3:0] q\n);\n  parameter W = 8'h%02X;\n  reg [31:0] mem [0:63];\n  wire n1;\n  assign n1 = a[0] & (q == 2) ? a[1] : a[2];\n"
        "  always @(posedge clk) begin\n    q <= a[3:0];\n    mem[a] <= q;\n  end\n  unit_%d u_next (.clk(clk), .a(a), .q(n1));\nendmodule\n",
        F.col("s_suppkey"), F.col("s_suppkey"), F.col("s_suppkey") % 256, F.col("s_suppkey") + 1,
    )
    return X.modules(load(spark, d, "supplier").select("s_suppkey", t.alias("text")))


@q("EXT-02", oracle="SELECT 'unit_' || s_suppkey AS module, name, direction, CAST(width AS INTEGER) AS width FROM supplier, (VALUES ('clk', 'input', 1), ('a', 'input', 8), ('q', 'output', 4)) v(name, direction, width)")
def ext_ports(spark: SparkSession, d: str) -> DataFrame:
    return X.ports(source(spark, d)).select("module", "name", "direction", "width")


@q("EXT-03", "EXT-16", oracle="SELECT 'unit_' || s_suppkey AS module, 'n1' AS name, 'wire' AS kind, CAST(1 AS INTEGER) AS bits FROM supplier UNION ALL SELECT 'unit_' || s_suppkey, 'mem', 'Memory Array', 2048 FROM supplier")
def ext_signals_memories(spark: SparkSession, d: str) -> DataFrame:
    s = source(spark, d)
    m = X.memories(s).select("module", "name", F.col("memory_type").alias("kind"), F.col("total_bits").alias("bits"))
    return X.signals(s).filter("name = 'n1'").select("module", "name", F.col("datatype").alias("kind"), F.col("width").alias("bits")).unionByName(m)


@q("EXT-04", oracle="SELECT 'unit_' || s_suppkey AS module, 'W' AS name, CAST(s_suppkey % 256 AS BIGINT) AS value FROM supplier")
def ext_parameters(spark: SparkSession, d: str) -> DataFrame:
    return X.parameters(source(spark, d)).select("module", "name", "value")


@q("EXT-06", oracle="SELECT 'unit_' || s_suppkey AS module, 'unit_' || (s_suppkey + 1) AS target, CAST(1 AS BIGINT) AS instance_count FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)")
def ext_depends_on(spark: SparkSession, d: str) -> DataFrame:
    return X.depends_on(X.instances(source(spark, d))).select("module", "target", "instance_count")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Modules whose blocks and expressions vary with their supplier: 1 to 13 statements, and three sizes of expressions."""
    k = F.col("s_suppkey")
    sens = F.when(k % 2 == 0, "posedge clk or negedge rst_n").otherwise("a or q")
    body = F.when(k % 13 == 0, "q = 0;").otherwise(F.concat(F.lit("begin "), F.repeat(F.lit("q <= q; "), (k % 13).cast("int")), F.lit("end")))
    rhs = F.when(k % 3 == 0, "a").when(k % 3 == 1, "a[0] & (q == 2) ? b : 4'hf").otherwise("((a & q) ^ (b | q)) ? (a + q) : ~(b - q)")
    t = F.concat(F.lit("module m_"), k, F.lit(" (input clk);\n  always @("), sens, F.lit(") "), body, F.lit("\n  assign n1 = "), rhs, F.lit(";\nendmodule\n"))
    return X.modules(load(spark, d, "supplier").select("s_suppkey", t.alias("text")))


@q("EXT-10", "EXT-11", oracle="""
WITH k AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE greatest(1, s_suppkey % 13 - 1) END AS n FROM supplier)
SELECT 'm_' || k AS module, CASE WHEN k % 2 = 0 THEN 'clk' END AS clock, CASE WHEN k % 2 = 0 THEN 'rst_n' END AS reset, CASE WHEN k % 2 = 0 THEN 'sequential' ELSE 'combinational' END AS block_type,
       CAST(n AS INTEGER) AS statement_count, CASE WHEN n <= 3 THEN 'Simple' WHEN n <= 10 THEN 'Moderate' ELSE 'Complex' END AS block_grade, 'n1' AS target,
       CASE k % 3 WHEN 0 THEN 'a' ELSE 'a,b,q' END AS reads, CAST(CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 19 END AS INTEGER) AS score, CASE k % 3 WHEN 0 THEN 'Simple' WHEN 1 THEN 'Moderate' ELSE 'Complex' END AS grade FROM k""")
def ext_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = blocks(spark, d)
    a = X.assigns(s).select("module", "target", F.array_join("reads", ",").alias("reads"), "score", F.col("complexity").alias("grade"))
    b = X.always_blocks(s).select("module", "clock", "reset", "block_type", "statement_count", F.col("complexity").alias("block_grade"))
    return b.join(a, "module")


@q("EXT-28", "EXT-29", oracle="""
SELECT n_nationkey AS k, lower(n_name) AS source, 'region ' || n_regionkey AS target, CASE n_nationkey % 4 WHEN 0 THEN 'INCLUDES' WHEN 1 THEN 'RELATED_TO' WHEN 2 THEN 'READS_FROM' ELSE 'TESTED_BY' END AS type FROM nation WHERE n_nationkey % 5 <> 4""")
def ext_model_output(spark: SparkSession, d: str) -> DataFrame:
    """Answers in fences, of which every fifth is broken; relations to unknown entities are dropped."""
    n = load(spark, d, "nation").withColumn("r", F.concat(F.lit("region "), "n_regionkey")).withColumn("n", F.lower("n_name"))
    rel_ = F.element_at(F.array(*[F.lit(x) for x in ("is part of", "likes", "reads-from", "Is_Verified By")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    e = lambda c: F.struct(c.alias("name"), F.lit("X").alias("type"), F.lit("d").alias("description"))
    obj = F.struct(F.array(e(F.col("n")), e(F.col("r"))).alias("entities"), F.array(F.struct(F.col("n").alias("source"), F.col("r").alias("target"), rel_.alias("type")), F.struct(F.col("n").alias("source"), F.lit("nobody").alias("target"), rel_.alias("type"))).alias("relations"))
    answer = F.when(F.col("n_nationkey") % 5 == 4, '{"entities": [').otherwise(F.concat(F.lit("```json\n"), F.to_json(obj), F.lit("\n```")))
    _, r = X.entities_and_relations(n.select(F.col("n_nationkey").alias("k"), answer.alias("text")), "k", "text")
    return r.select("k", "source", "target", "type")


@q("SRC-03", oracle="SELECT 'nation' AS kind, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def src_json_array(spark: SparkSession, d: str) -> DataFrame:
    """Two files that hold one JSON array each, of tables that don't grow, read together."""
    p = scratch(spark, "json-arrays")
    for kind, key, name in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        rows = load(spark, d, kind).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(name).alias("name"))
        rows.agg(F.to_json(F.collect_list(F.struct("kind", "key", "name")))).coalesce(1).write.mode("append").text(p)
    return files.read_json_array(spark, p, "kind string, key int, name string")
