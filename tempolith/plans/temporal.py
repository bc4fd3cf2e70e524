"""Temporal queries: replayed versions, point-in-time, diffs, epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as tm
from ..registry import CORE
from ..tables import load, rounded_seconds

#: Versions of a part: every order that touches it opens one, the next one closes it.
VERSIONS_SQL = """
  SELECT l_partkey, o_orderkey, o_custkey, l_linenumber, CAST(epoch(o_orderdate) AS BIGINT) AS valid_from_ts,
         coalesce(lead(CAST(epoch(o_orderdate) AS BIGINT)) OVER w, 9999999999) AS valid_to_ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WINDOW w AS (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_quantity, l_extendedprice)
"""
#: 1997-01-01 in epoch seconds.
T = 852076800


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).withColumn("ts", rounded_seconds("o_orderdate"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tm.close_intervals(changes(spark, sf_dir), ["l_partkey"], "ts", ["o_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return v.select("l_partkey", "o_orderkey", "o_custkey", "l_linenumber", "valid_from_ts", "valid_to_ts")


def live(spark: SparkSession, sf_dir: str, columns: list[str], *times: int, until: bool = False) -> DataFrame:
    """Versions of parts at some times, from their changes."""
    return tm.live_at(changes(spark, sf_dir), ["l_partkey"], "ts", ["o_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], ["o_orderkey", *columns], *times, until=until)


@CORE.query("TM-08", "TM-01", "AG-13", "SL-03", oracle=f"""
SELECT o_custkey, count(*) AS live_versions FROM ({VERSIONS_SQL}) v
WHERE valid_from_ts <= {T} AND valid_to_ts > {T}
GROUP BY o_custkey ORDER BY live_versions DESC, o_custkey LIMIT 10""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        live(spark, sf_dir, ["o_custkey"], T)
        .groupBy("o_custkey").agg(F.count("*").alias("live_versions"))
        .orderBy(F.desc("live_versions"), "o_custkey").limit(10)
    )


q = CORE.query
T1, T2 = 820454400, 852076800


@q("TM-01", oracle=f"SELECT l_partkey, o_orderkey, valid_from_ts, valid_to_ts FROM ({VERSIONS_SQL}) WHERE valid_from_ts <= {T1} AND valid_to_ts > {T1}")
def tm_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir, [], T1, until=True).select("l_partkey", "o_orderkey", "valid_from_ts", "valid_to_ts")


@q("TM-01", oracle=f"SELECT count(*) AS n FROM ({VERSIONS_SQL}) WHERE valid_from_ts <= {T2} AND valid_to_ts >= {T2}")
def tm_as_of_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.as_of(versions(spark, sf_dir), T2, closed=True).agg(F.count("*").alias("n"))


@q("TM-02", "ST-04", oracle=f"""
WITH v AS ({VERSIONS_SQL}), a AS (SELECT DISTINCT o_custkey FROM v WHERE valid_from_ts <= {T1} AND valid_to_ts > {T1}), b AS (SELECT DISTINCT o_custkey FROM v WHERE valid_from_ts <= {T2} AND valid_to_ts > {T2})
SELECT o_custkey, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT o_custkey, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def tm_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.diff_at(live(spark, sf_dir, ["o_custkey"], T1, T2), T1, T2, "o_custkey")


@q("TM-04", oracle="""
WITH c AS (SELECT o_orderkey, o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'),
g AS (SELECT o_orderkey, count(DISTINCT l_partkey) AS parts FROM c GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2) SELECT DISTINCT o_orderkey, o_custkey, parts FROM g JOIN c USING (o_orderkey)""")
def tm_change_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir).filter((F.col("ts") >= 820454400) & (F.col("ts") < 836179200))
    return c.groupBy("o_orderkey", "o_custkey").agg(F.countDistinct("l_partkey").alias("parts")).filter("parts >= 2")


@q("TM-05", oracle=f"""
SELECT l_partkey, o_orderkey, ts FROM (SELECT l_partkey, o_orderkey, valid_from_ts AS ts, row_number() OVER (PARTITION BY l_partkey ORDER BY valid_from_ts, o_orderkey, l_linenumber) AS r FROM ({VERSIONS_SQL})) WHERE r = 1 AND ts >= {T1} AND ts < {T2}""")
def tm_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = versions(spark, sf_dir).groupBy("l_partkey").agg(F.min(F.struct(F.col("valid_from_ts").alias("ts"), "o_orderkey")).alias("f"))
    return first.select("l_partkey", "f.o_orderkey", "f.ts").filter((F.col("ts") >= T1) & (F.col("ts") < T2))


@q("TM-06", "JN-10", oracle=f"""
WITH v AS (SELECT *, year(to_timestamp(valid_from_ts) AT TIME ZONE 'UTC') AS y FROM ({VERSIONS_SQL}))
SELECT l_partkey, y, o_orderkey, valid_from_ts FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, y ORDER BY valid_from_ts DESC, o_orderkey DESC, l_linenumber DESC) AS r FROM v) WHERE r = 1""")
def tm_versions_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir).withColumn("y", F.year(F.timestamp_seconds("valid_from_ts")).cast("long"))
    best = v.groupBy("l_partkey", "y").agg(F.max(F.struct("valid_from_ts", "o_orderkey", "l_linenumber")).alias("b"))
    return best.select("l_partkey", "y", "b.o_orderkey", "b.valid_from_ts")


@q("TM-07", oracle="SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def tm_commit_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("o_orderkey", "l_partkey")


@q("TM-08", "WN-03", oracle=VERSIONS_SQL.replace("SELECT l_partkey", "SELECT DISTINCT l_partkey"))
def tm_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).distinct()


@q("TM-08", "ST-06", oracle="""
WITH s AS (SELECT l_partkey AS module, l_orderkey AS commit_seq, CAST(sum(l_quantity) AS BIGINT) % 7 AS digest FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, lag(digest) OVER (PARTITION BY module ORDER BY commit_seq) AS before FROM s), k AS (SELECT * FROM c WHERE before IS NULL OR before <> digest)
SELECT module, commit_seq, digest, CASE WHEN before IS NULL THEN 'introduced_in' ELSE 'modified_in' END AS role, coalesce(lead(commit_seq) OVER (PARTITION BY module ORDER BY commit_seq), 9999999999) AS until FROM k""")
def tm_replay_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of modules to versions: one only where the digest differs from the snapshot before."""
    s = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("module"), F.col("l_orderkey").alias("commit_seq")).agg((F.sum("l_quantity").cast("long") % 7).alias("digest"))
    return tm.replay(s, "module", "commit_seq", "digest")


#: Epochs of commits: orders are commits, market segments repositories, some orders have tags, and an order changes its distinct parts of 40.
EPOCHS = """
RECURSIVE n AS (SELECT l_orderkey, count(DISTINCT l_partkey) / 40 AS share FROM lineitem GROUP BY 1),
c AS MATERIALIZED (
  SELECT c_mktsegment AS repo, o_orderkey AS commit, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
         CASE WHEN o_orderkey % 997 = 0 THEN 'milestone_' || (o_orderkey % 9) || '_1_rc' END AS tag, coalesce(share, 0) AS share,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) AS i
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON o_orderkey = l_orderkey
), f AS (
  SELECT repo, commit, ts, i, 'initial_commit' AS label, ts AS boundary, 'development' AS last FROM c WHERE i = 1
  UNION ALL
  SELECT repo, commit, ts, i, coalesce(label, last), CASE WHEN label IS NULL THEN boundary ELSE ts END, coalesce(label, last) FROM (
    SELECT c.repo, c.commit, c.ts, c.i, f.boundary, f.last,
           CASE WHEN c.tag IS NOT NULL THEN c.tag WHEN c.ts - f.boundary > 180 * 86400 THEN 'period_' || strftime(make_timestamp(c.ts * 1000000), '%Y_%m')
                WHEN c.share >= 0.15 THEN 'major_refactor_' || left(CAST(c.commit AS VARCHAR), 7) END AS label
    FROM f JOIN c ON c.repo = f.repo AND c.i = f.i + 1)
)"""


def epoch_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_partkey") / 40).alias("ratio"))
    c = o.join(n, o.o_orderkey == n.l_orderkey, "left").select(
        F.col("c_mktsegment").alias("repo"), F.col("o_orderkey").alias("commit"), rounded_seconds("o_orderdate").alias("ts"),
        F.when(F.col("o_orderkey") % 997 == 0, F.concat(F.lit("v"), F.col("o_orderkey") % 9, F.lit(".1-rc"))).alias("tag"), F.coalesce("ratio", F.lit(0.0)).alias("change_ratio"),
    )
    return tm.detect_epochs(c)


@q("TM-09", "WN-05", oracle=f"""
WITH {EPOCHS} SELECT repo, commit, ts, label, CASE WHEN starts_with(label, 'milestone_') THEN 'milestone_tag' WHEN starts_with(label, 'major_refactor_') THEN 'major_refactor'
  WHEN label IN ('initial_commit', 'development') THEN label ELSE 'other' END AS epoch_type FROM f""")
def tm_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch labels of the commits of each repository: a fold over earlier decisions."""
    return epoch_commits(spark, sf_dir)


@q("TM-10", "TM-11", oracle=f"""
WITH {EPOCHS},
b AS (SELECT repo, min_by(commit, (ts, commit)) AS commit, l_partkey AS module FROM c JOIN lineitem ON commit = l_orderkey GROUP BY repo, l_partkey),
m AS (SELECT repo, commit, list_sort(list('part ' || module))[1:5] AS tags FROM b GROUP BY 1, 2),
a AS (SELECT f.repo, label AS epoch, max_by(f.commit, (ts, f.commit)) AS commit, max(ts) AS ts, max_by(tags, (ts, f.commit)) AS tags FROM f JOIN m ON f.repo = m.repo AND f.commit = m.commit GROUP BY 1, 2),
s AS (
  SELECT repo, epoch, 'subsystem_addition' AS situation, 'Subsystem Addition' AS title, commit AS first_commit, commit AS last_commit, ts AS from_ts, ts AS to_ts,
         array_to_string(tags, '|') AS tags, 'unknown' AS outcome, 'New module(s): ' || array_to_string(tags, ', ') AS notes FROM a
  UNION ALL
  SELECT repo, label, 'release_prep', 'Release Prep', min_by(commit, (ts, commit)), max_by(commit, (ts, commit)), min(ts), max(ts),
         'release|' || replace(substring(label, 11), '_', '.'), 'milestone_release', 'Commits leading to release tag ' || replace(substring(label, 11), '_', '.')
  FROM f WHERE starts_with(label, 'milestone_') GROUP BY 1, 2
  UNION ALL
  SELECT repo, label, 'major_refactor', 'Major Refactor', min_by(commit, (ts, commit)), max_by(commit, (ts, commit)), min(ts), max(ts), 'refactor|' || repo, 'unknown', 'Major RTL refactor in epoch ' || label
  FROM f WHERE starts_with(label, 'major_refactor_') GROUP BY 1, 2
)
SELECT left(md5(repo || ':' || epoch || ':' || situation), 16) AS key, title || ' ' || chr(8212) || ' ' || repo || ' @ ' || epoch AS label, repo, epoch, situation, first_commit, last_commit, from_ts, to_ts, tags, outcome, notes FROM s""")
def tm_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Situations in the epochs of each repository; a part comes with the first order that has it."""
    from ..sources.shared import checkpointed

    c = checkpointed(epoch_commits(spark, sf_dir).select("repo", "commit", "ts", F.col("label").alias("epoch")))
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("part "), "l_partkey").alias("label"))
    new = c.join(lines, "commit").groupBy("repo", "label").agg(F.min(F.struct("ts", "commit"))["commit"].alias("commit"))
    return tm.situations(c, new).withColumn("tags", F.array_join("tags", "|"))


@q("TM-11", oracle="""
SELECT event_id, user_id FROM events WHERE list_has_any(string_split(event_type || ',' || CASE WHEN value > 80 THEN 'high' ELSE 'low' END, ','), ['high', 'error'])""")
def tm_deja_vu(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array("event_type", F.when(F.col("value") > 80, "high").otherwise("low"))
    return load(spark, sf_dir, "events").filter(F.exists(tags, lambda t: t.isin("high", "error"))).select("event_id", "user_id")


@q("TM-12", "AG-12", oracle="""
SELECT o_custkey, count(*) AS total_commits, min(CAST(epoch(o_orderdate) AS BIGINT)) AS first_seen, max(CAST(epoch(o_orderdate) AS BIGINT)) AS last_seen FROM orders GROUP BY 1 ORDER BY total_commits DESC, o_custkey LIMIT 10""")
def tm_author_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.people import rollup

    o = load(spark, sf_dir, "orders").select("o_custkey", rounded_seconds("o_orderdate").alias("ts"))
    return rollup(o, "o_custkey", "ts").orderBy(F.desc("total_commits"), "o_custkey").limit(10)


@q("TM-13", "GR-06", oracle="""
SELECT DISTINCT r_name, c_custkey, o_orderkey, l_partkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE r_regionkey = 2 AND o_orderstatus = 'F' AND l_returnflag = 'R' AND o_totalprice > 300000""")
def tm_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import typed_chain

    start = load(spark, sf_dir, "region").filter("r_regionkey = 2").select(F.col("r_regionkey").alias("node"))
    d = typed_chain(start, [
        (load(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", None),
        (load(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", None),
        (load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)),
        (load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.col("l_returnflag") == "R"),
    ])
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("node"), "r_name")
    return d.join(r, "node").select("r_name", F.col("n2").alias("c_custkey"), F.col("n3").alias("o_orderkey"), F.col("n4").alias("l_partkey")).distinct()


@q("TM-14", oracle="""
SELECT o_orderkey, split_part('epoch — ' || o_orderpriority || ' of ' || o_orderstatus, ' — ', 2) AS label, regexp_extract(o_orderpriority, '^(\\d)-', 1) AS tag FROM orders""")
def tm_epoch_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("epoch — "), "o_orderpriority", F.lit(" of "), "o_orderstatus")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.split_part(label, F.lit(" — "), F.lit(2)).alias("label"), F.regexp_extract("o_orderpriority", r"^(\d)-", 1).alias("tag"))


@q("FLT-12", "TM-01", "JN-08", oracle=f"SELECT l_partkey, o_orderkey, valid_from_ts, valid_to_ts FROM ({VERSIONS_SQL}) WHERE valid_from_ts BETWEEN {T1} AND {T2} AND valid_to_ts <= {T2}")
def tm_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that began and ended within a period: a box over both ends, read from a table along a curve."""
    from ..operators import curve
    from ..sources.shared import scratch

    path = scratch(spark, "versions-on-a-curve")
    c = curve.write(versions(spark, sf_dir), ["valid_from_ts", "valid_to_ts"], path, 32)
    return curve.box(spark, path, c, [T1, None], [T2, T2]).select("l_partkey", "o_orderkey", "valid_from_ts", "valid_to_ts")
