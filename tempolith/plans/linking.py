"""Consolidation, bridges between repositories, and paths, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bridge, consolidate, paths, quality, signatures
from ..registry import CORE
from ..sources.shared import scratch
from ..tables import load
from .graph import cut
from .matching import er_fuzzy_pairs

q = CORE.query

# --- consolidation ------------------------------------------------------------------------------------

#: Raw entities: parts, every fifth name in capitals. A relation leads from each part to the one of a third of its key.
RAW = "SELECT p_partkey AS key, p_type AS type, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand AS description FROM part"
_WORDS = "string_split({}, ' ')"
GOLDEN = f"""
raw AS ({RAW}), gold AS MATERIALIZED (
  SELECT md5(type || ':' || lower(trim(name))) AS golden, type, arg_min(name, {{'l': -length(name), 'k': key}}) AS name, string_agg(DISTINCT description, ' | ' ORDER BY description) AS description, list(DISTINCT name) AS names, count(*) AS members
  FROM raw GROUP BY type, lower(trim(name))
), pair AS (
  SELECT a.golden AS a, b.golden AS b, lower(a.name) AS x, lower(b.name) AS y, levenshtein(lower(a.name), lower(b.name)) AS distance, least(length(a.name), length(b.name)) AS short FROM gold a JOIN gold b ON a.type = b.type AND a.golden <> b.golden
), near AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT *, CASE WHEN short < 4 AND (starts_with(x, y) OR starts_with(y, x)) THEN 0 WHEN short <= 5 THEN 1 - distance / short
              ELSE 0.6 * (1 - distance / short) + 0.4 * len(list_intersect({_WORDS.format('x')}, {_WORDS.format('y')})) / least(len({_WORDS.format('x')}), len({_WORDS.format('y')})) END AS c
    FROM pair WHERE distance BETWEEN 1 AND 3) WHERE c >= 0.5
), walk AS (SELECT golden AS s, golden AS t FROM gold UNION SELECT s, b FROM walk JOIN near ON t = a),
comp AS (SELECT s AS golden, min(t) AS c FROM walk GROUP BY 1),
lead AS (SELECT c, arg_max(golden, {{'l': length(name), 'n': name, 'g': golden}}) AS prime FROM comp JOIN gold USING (golden) GROUP BY c),
to_prime AS MATERIALIZED (SELECT golden, prime FROM comp JOIN lead USING (c))"""


def raw_entities(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("type"), name.alias("name"), F.col("p_brand").alias("description"))


def raw_relations(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return load(spark, d, "part").filter("p_partkey > 0").select(p.alias("relation"), p.alias("src"), F.floor(p / 3).alias("dst"), F.lit("DEPENDS_ON").alias("type"))


@q("PL-01", "AG-09", oracle=f"""
WITH raw AS ({RAW}), g AS (SELECT md5(type || ':' || lower(trim(name))) AS golden, * FROM raw)
SELECT golden, type, arg_min(name, {{'l': -length(name), 'k': key}}) AS name, string_agg(DISTINCT description, ' | ' ORDER BY description) AS description,
       array_to_string(list_sort(list_filter(list(DISTINCT name), lambda x: x <> arg_min(name, {{'l': -length(name), 'k': key}}))), '|') AS aliases, count(*) AS members
FROM g GROUP BY golden, type""")
def er_golden(spark: SparkSession, d: str) -> DataFrame:
    """The first stage: one golden entity for each type and name."""
    return consolidate.golden_entities(raw_entities(spark, d)).withColumn("aliases", F.array_join("aliases", "|"))


@q("PL-01", "AG-11", "PL-10", oracle=f"""
WITH raw AS ({RAW}), g AS (SELECT md5(type || ':' || lower(trim(name))) AS golden, key FROM raw),
r AS (SELECT p_partkey AS relation, a.golden AS src, b.golden AS dst FROM part JOIN g a ON a.key = p_partkey JOIN g b ON b.key = p_partkey // 3 WHERE p_partkey > 0)
SELECT md5(src || dst || 'DEPENDS_ON') AS key, src, dst, count(*) AS evidence, string_agg(relation, ',' ORDER BY relation) AS provenance FROM r GROUP BY src, dst""")
def er_swept(spark: SparkSession, d: str) -> DataFrame:
    """Relations between golden entities, with the raw ones that they come from."""
    r = consolidate.swept(raw_relations(spark, d), consolidate.consolidates(raw_entities(spark, d)))
    return r.select("key", "src", "dst", "evidence", F.array_join(F.col("provenance").cast("array<string>"), ",").alias("provenance"))


@q("PL-02", "GR-17", "JN-07", oracle=f"""
WITH RECURSIVE {GOLDEN}, m AS (SELECT prime, g.*, prime = g.golden AS own FROM to_prime t JOIN gold g ON t.golden = g.golden)
SELECT prime AS golden, min(type) AS type, max(name) FILTER (own) AS name, string_agg(description, ' | ' ORDER BY own DESC, name, golden) AS description,
       array_to_string(list_sort(list_filter(list_distinct(flatten(list(names))), lambda x: x <> max(name) FILTER (own))), '|') AS aliases, CAST(sum(members) AS BIGINT) AS members, count(*) - 1 AS merged
FROM m GROUP BY prime""".replace("list_filter(list_distinct(flatten(list(names))), lambda x: x <> max(name) FILTER (own))", "list_filter(list_distinct(flatten(list(names))), lambda x: x <> (max(name) FILTER (own)))"))
def er_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """The second stage: golden entities after fuzzy merges, with united aliases and joined descriptions."""
    c = consolidate.consolidate(raw_entities(spark, d), raw_relations(spark, d), cut, 3, 0.5)
    return c["golden"].withColumn("aliases", F.array_join("aliases", "|"))


@q("PL-02", "AG-11", oracle=f"""
WITH RECURSIVE {GOLDEN}, r AS (
  SELECT p_partkey AS relation, x.prime AS src, y.prime AS dst FROM part JOIN raw a ON a.key = p_partkey JOIN raw b ON b.key = p_partkey // 3
  JOIN to_prime x ON x.golden = md5(a.type || ':' || lower(trim(a.name))) JOIN to_prime y ON y.golden = md5(b.type || ':' || lower(trim(b.name))) WHERE p_partkey > 0)
SELECT src, dst, count(*) AS evidence, md5(string_agg(relation, ',' ORDER BY relation)) AS provenance FROM r GROUP BY src, dst""")
def er_repointed(spark: SparkSession, d: str) -> DataFrame:
    """Relations after the second stage: between merged entities."""
    c = consolidate.consolidate(raw_entities(spark, d), raw_relations(spark, d), cut, 3, 0.5)
    return c["relations"].select("src", "dst", "evidence", F.md5(F.array_join(F.col("provenance").cast("array<string>"), ",")).alias("provenance"))


# --- bridges between repositories ------------------------------------------------------------------------

#: A part's ports: its brand, type and the words of its name, each with its size.
PORTS = "SELECT p_partkey AS k, p_partkey % 2 AS side, list_distinct(list_transform(list_concat([p_brand, p_type], string_split(p_name, ' ')), lambda x: lower(x) || '_' || p_size)) AS v FROM part"


@q("PL-08", "SIM-06", oracle=f"""
WITH s AS ({PORTS}), e AS (SELECT k, side, unnest(v) AS x FROM s), c AS (SELECT a.k AS a, b.k AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.side < b.side GROUP BY 1, 2)
SELECT c.a, c.b, round(0.6 * m / (len(x.v) + len(y.v) - m) + 0.4 * (1 - abs(len(x.v) - len(y.v)) / greatest(len(x.v), len(y.v))), 4) AS score
FROM c JOIN s x ON c.a = x.k JOIN s y ON c.b = y.k WHERE 0.6 * m / (len(x.v) + len(y.v) - m) + 0.4 * (1 - abs(len(x.v) - len(y.v)) / greatest(len(x.v), len(y.v))) >= 0.75""")
def br_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Parts of two repositories whose ports are alike."""
    sized = F.transform(F.concat(F.array("p_brand", "p_type"), F.split("p_name", " ")), lambda x: F.concat(F.lower(x), F.lit("_"), F.col("p_size").cast("string")))
    s = load(spark, d, "part").select((F.col("p_partkey") % 2).alias("side"), F.col("p_partkey").alias("k"), sized.alias("ports"))
    return signatures.similar_sets(s, "side", "k", "ports", 0.75, cut, digits=4).select("a", "b", "score")


@q("PL-08", "JN-14", oracle="""
WITH n AS (SELECT lower(p_name) AS name, p_partkey % 2 AS side, min(p_partkey) AS k FROM part GROUP BY 1, 2)
SELECT a.k AS src, b.k AS dst, 0.85 AS confidence, 'even -> odd' AS rule, left(md5(a.k || ':' || b.k || ':evolved'), 16) AS key FROM n a JOIN n b ON a.name = b.name AND a.side = 0 AND b.side = 1""")
def br_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one repository that have an ancestor of the same name in another."""
    n = load(spark, d, "part").groupBy(F.lower("p_name").alias("name"), (F.col("p_partkey") % 2).alias("side")).agg(F.min("p_partkey").alias("k"))
    return signatures.lineage(n.filter("side = 0"), n.filter("side = 1"), "k", "name", "even -> odd", 0.85)


@q("PL-14", "AG-07", oracle=f"SELECT floor(round(confidence / 0.1, 9)) * 0.1 AS bucket, count(*) AS n FROM ({CORE.entries['er_fuzzy_pairs'].oracle}) GROUP BY 1")
def br_quality(spark: SparkSession, d: str) -> DataFrame:
    """How confident fuzzy matches are: a histogram."""
    return quality.histogram(er_fuzzy_pairs(spark, d), "confidence")


#: Items are the names of parts, entities the names of each type. What is compatible and near is by their numbers.
_ITEMS = """items AS (SELECT p_name AS item, CASE length(p_name) % 3 WHEN 0 THEN 'architecture' WHEN 1 THEN 'module' ELSE 'signal' END AS kind, p_name AS label, CASE WHEN min(p_partkey) % 2 = 0 THEN p_name || ' unit' END AS expanded,
  p_name || ' in ' || lower(min(p_type)) AS said, CASE WHEN min(p_partkey) % 4 <> 0 THEN 'made by ' || lower(replace(min(p_brand), '#', '')) END AS context, min(p_partkey) AS k FROM part GROUP BY p_name),
ents AS (SELECT min(p_partkey) AS key, CASE WHEN min(p_partkey) % 3 = 0 THEN p_name || ' unit' ELSE p_name END AS name, 'the ' || lower(p_type) || ' ' || p_name || ' by ' || lower(replace(min(p_brand), '#', '')) AS description, p_type AS type FROM part GROUP BY p_type, p_name),
compatible AS (SELECT kind, type FROM (SELECT DISTINCT kind FROM items), (SELECT DISTINCT type FROM ents) WHERE (length(type) + length(kind)) % 2 = 0),
neighbours AS (SELECT item, key FROM items JOIN ents ON ents.key % 16 = items.k % 16 WHERE items.k % 5 <> 0)"""
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_STOPLESS = "list_filter(list_distinct(string_split({}, ' ')), lambda x: x NOT IN ('the', 'by'))"


@q("PL-03", "PL-04", "TXT-03", oracle=f"""
WITH {_ITEMS}, d AS (SELECT key, list_transform({_TOKENS.format("name || ' ' || description")}, lambda x: md5(type) || x) AS t FROM ents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT key, token, dl, count(*) AS tf FROM (SELECT key, unnest(t) AS token, len(t) AS dl FROM d) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT DISTINCT item, unnest(list_transform({_TOKENS.format("concat_ws(' ', label, expanded)")}, lambda x: md5(type) || x)) AS token FROM items JOIN compatible USING (kind)),
c AS (SELECT item, key FROM (SELECT item, key, row_number() OVER (PARTITION BY item ORDER BY round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 7) DESC, key) AS r FROM w JOIN tf USING (token) JOIN df USING (token), n GROUP BY item, key) WHERE r <= 10),
p AS (SELECT c.item, c.key, kind, label, coalesce(expanded, '') AS expanded, said, context, name, description,
  EXISTS (SELECT 1 FROM neighbours x WHERE x.item = c.item) AS known, EXISTS (SELECT 1 FROM neighbours x WHERE x.item = c.item AND x.key = c.key) AS near FROM c JOIN items USING (item) JOIN ents USING (key)),
s AS (SELECT *, greatest(0.7 * jaro_winkler_similarity(CASE WHEN length(expanded) > length(label) THEN expanded ELSE label END, name) + 0.3 * jaro_winkler_similarity(said, description),
  CASE WHEN label = name OR expanded = name THEN 0.95
       WHEN list_has_all(string_split(name, ' '), string_split(label, ' ')) OR list_has_all(string_split(label, ' '), string_split(name, ' ')) OR (expanded <> '' AND (list_has_all(string_split(name, ' '), string_split(expanded, ' ')) OR list_has_all(string_split(expanded, ' '), string_split(name, ' ')))) THEN 0.85
       WHEN contains(name, label) OR contains(label, name) OR (expanded <> '' AND (contains(name, expanded) OR contains(expanded, name))) THEN 0.80 ELSE 0 END) AS s0,
  len(list_intersect({_STOPLESS.format('context')}, {_STOPLESS.format('description')})) / least(len({_STOPLESS.format('context')}), len({_STOPLESS.format('description')})) AS shared FROM p),
g AS (SELECT *, CASE WHEN context IS NULL THEN s0 WHEN shared > 0 THEN 0.7 * s0 + 0.3 * shared ELSE 0.9 * s0 END AS s1 FROM s),
b AS (SELECT item, key, kind, CASE WHEN NOT known THEN s1 WHEN near THEN least(1.0, s1 * 1.2) ELSE s1 * 0.95 END AS score FROM g),
r AS (SELECT *, row_number() OVER v AS r, lead(score) OVER v AS nxt FROM b WINDOW v AS (PARTITION BY item ORDER BY round(score, 9) DESC, key))
SELECT item, key, round(score, 6) AS score, round(score - coalesce(nxt, 0), 6) AS margin FROM r WHERE r = 1 AND score >= CASE kind WHEN 'architecture' THEN 0.5 WHEN 'module' THEN 0.7 ELSE 0.6 END""")
def br_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Names resolved to golden entities: the ten best by words of compatible types, then scores, context and neighbourhood."""
    p = load(spark, d, "part")
    first = F.min("p_partkey")
    i = p.groupBy("p_name").agg(first.alias("k"), F.lower(F.min("p_type")).alias("t"), F.replace(F.lower(F.min("p_brand")), F.lit("#"), F.lit("")).alias("b"))
    kind = F.when(F.length("p_name") % 3 == 0, "architecture").when(F.length("p_name") % 3 == 1, "module").otherwise("signal")
    items = i.select(
        F.col("p_name").alias("item"), kind.alias("kind"), F.col("p_name").alias("label"), F.when(F.col("k") % 2 == 0, F.concat("p_name", F.lit(" unit"))).alias("expanded"),
        F.concat("p_name", F.lit(" in "), "t").alias("said"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("made by "), "b")).alias("context"), "k",
    )
    e = p.groupBy("p_type", "p_name").agg(first.alias("key"), F.replace(F.lower(F.min("p_brand")), F.lit("#"), F.lit("")).alias("b"))
    ents = e.select("key", F.when(F.col("key") % 3 == 0, F.concat("p_name", F.lit(" unit"))).otherwise(F.col("p_name")).alias("name"), F.concat(F.lit("the "), F.lower("p_type"), F.lit(" "), "p_name", F.lit(" by "), "b").alias("description"), F.col("p_type").alias("type"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("architecture", "module", "signal")])).alias("kind")
    compatible = ents.select("type").distinct().select("type", kinds).filter((F.length("type") + F.length("kind")) % 2 == 0)
    neighbours = items.filter("k % 5 <> 0").select("item", (F.col("k") % 16).alias("m")).join(ents.select("key", (F.col("key") % 16).alias("m")), "m").select("item", "key")
    found = bridge.bridge(items.drop("k"), ents, compatible, neighbours, scratch(spark, "bridge-index"), cut)
    return found.select("item", "key", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


# --- paths ------------------------------------------------------------------------------------------------

#: Part p leads to p div 2 and to p div 3, at a cost.
HALVES = "SELECT DISTINCT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part WHERE p_partkey > 0"
_WALKS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, CAST(1 + (src + dst) % 4 AS DOUBLE) AS w FROM ({HALVES})),
p AS (SELECT max(p_partkey) AS node, [max(p_partkey)] AS path, 0.0::DOUBLE AS cost FROM part UNION ALL SELECT e.dst, list_append(path, e.dst), cost + w FROM p JOIN e ON p.node = e.src)"""


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    p = load(spark, d, "part").select(F.col("p_partkey").alias("src"))
    e = p.filter("src > 0").withColumn("dst", F.explode(F.array_distinct(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3))))).withColumn("w", 1 + (F.col("src") + F.col("dst")) % 4)
    return e, p.agg(F.max("src")).first()[0]


def _line(path: str) -> F.Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


@q("GR-10", oracle=_WALKS + " SELECT CAST(row_number() OVER (ORDER BY cost, path) AS INTEGER) AS rank, array_to_string(path, '>') AS path, cost FROM p WHERE node = 0 ORDER BY cost, p.path LIMIT 6")
def gr_kpaths(spark: SparkSession, d: str) -> DataFrame:
    """The six cheapest ways from the last part to part 0."""
    e, last = halves(spark, d)
    return paths.k_shortest_paths(e, last, 0, 6, weight="w", keep=cut).select("rank", _line("path").alias("path"), "cost")


@q("GR-10", oracle=_WALKS + " SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM p WHERE node = 0 AND len(path) = (SELECT min(len(path)) FROM p WHERE node = 0)")
def gr_all_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Every way of fewest steps from the last part to part 0."""
    e, last = halves(spark, d)
    return paths.all_shortest_paths(e, last, 0, keep=cut).select(_line("path").alias("path"), "length")


@q("GR-10", "GR-11", oracle=_WALKS + ", l AS (SELECT node, len(path) - 1 AS n FROM p) SELECT node, CAST(n AS INTEGER) AS distance, count(*) AS paths FROM l JOIN (SELECT node, min(n) AS n FROM l GROUP BY 1) USING (node, n) GROUP BY 1, 2")
def gr_path_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many ways of fewest steps lead from the last part to each one that it reaches."""
    e, last = halves(spark, d)
    return paths.shortest_path_counts(e, last, keep=cut).select("node", "distance", F.col("paths").cast("long").alias("paths"))
