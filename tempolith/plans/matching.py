"""Similarity, text search, entity resolution, bridging and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import resolve, retrieve, text
from ..operators import similarity as sim
from ..operators.components import connected_components
from ..registry import CORE
from ..tables import load
from .graph import cut

q = CORE.query

NAMES = "(SELECT p_name AS n, min(p_partkey) AS k FROM part GROUP BY 1)"


def names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").groupBy(F.col("p_name").alias("n")).agg(F.min("p_partkey").alias("k"))


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the few distinct names: 64 at every scale."""
    n = names(spark, d)
    return n.select(F.col("n").alias("a"), F.col("k").alias("ka")).join(n.select(F.col("n").alias("b"), F.col("k").alias("kb")), F.col("ka") < F.col("kb"))


@q("SIM-02", oracle=f"SELECT a.n AS a, b.n AS b, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n), 1), 6) AS s FROM {NAMES} a JOIN {NAMES} b ON a.k < b.k")
def sim_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", F.round(sim.lev_ratio(F.col("a"), F.col("b")), 6).alias("s"))


@q("SIM-01", oracle=f"""
SELECT a.n AS a, b.n AS b, round(jaro_winkler_similarity(a.n, b.n), 6) AS name,
       round(0.7 * jaro_winkler_similarity(a.n, b.n) + 0.3 * jaro_winkler_similarity(reverse(a.n), reverse(b.n)), 6) AS weighted
FROM {NAMES} a JOIN {NAMES} b ON a.k < b.k""")
def sim_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    """Names, and names with a second field that counts for less; read backwards, a name stands for a description."""
    p = name_pairs(spark, d).withColumn("name", sim.jaro_winkler(F.col("a"), F.col("b"))).withColumn("other", sim.jaro_winkler(F.reverse("a"), F.reverse("b")))
    return p.select("a", "b", F.round("name", 6).alias("name"), F.round(sim.weighted_fields(F.col("name"), F.col("other")), 6).alias("weighted"))


_W = "string_split({}, ' ')"
#: Texts of name pairs with stop words among them.
_STOPPED = "list_filter(list_distinct(string_split({}, ' ')), lambda x: x NOT IN ('the', 'of', 'at'))"


@q("SIM-03", oracle=f"""
WITH t AS (SELECT k, 'The ' || n || ' of the rig_' || (k % 3) || ' at ' || upper(n) AS t FROM {NAMES}),
w AS (SELECT k, t, {_STOPPED.format('lower(t)')} AS w FROM t)
SELECT a.t AS a, b.t AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM w a JOIN w b ON a.k < b.k""")
def sim_tokens(spark: SparkSession, d: str) -> DataFrame:
    def text_of(c: str) -> F.Column:
        n, k = F.col(c), F.col(f"k{c}")
        return F.concat(F.lit("The "), n, F.lit(" of the rig_"), k % 3, F.lit(" at "), F.upper(n))

    p = name_pairs(spark, d).select(text_of("a").alias("a"), text_of("b").alias("b"))
    return p.select("a", "b", F.round(sim.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


_PARTS = "string_split({}, '_')"
_SUFFIX = "CASE WHEN contains({0}, '_') THEN substring({0}, instr({0}, '_') + 1) ELSE {0} END"


@q("SIM-05", oracle=f"""
WITH l AS (SELECT k, 'r' || (k % 2) || '_' || replace(n, ' ', '_') AS l FROM {NAMES} UNION ALL SELECT k + 1000000000, 'x_' || replace(n, ' ', '_') FROM {NAMES})
SELECT a.l AS a, b.l AS b,
       CASE WHEN {_SUFFIX.format('a.l')} = {_SUFFIX.format('b.l')} THEN 1.0
            ELSE round(len(list_intersect({_PARTS.format('a.l')}, {_PARTS.format('b.l')})) / len(list_distinct(list_concat({_PARTS.format('a.l')}, {_PARTS.format('b.l')}))), 4) END AS s
FROM l a JOIN l b ON a.k < b.k""")
def sim_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of two repositories, of which some differ in the prefix only."""
    under = F.replace("n", F.lit(" "), F.lit("_"))
    n = names(spark, d)
    one = n.select("k", F.concat(F.lit("r"), F.col("k") % 2, F.lit("_"), under).alias("l"))
    labels = one.unionByName(n.select((F.col("k") + 1000000000).alias("k"), F.concat(F.lit("x_"), under).alias("l")))
    p = labels.select(F.col("k").alias("ka"), F.col("l").alias("a")).join(labels.select(F.col("k").alias("kb"), F.col("l").alias("b")), F.col("ka") < F.col("kb"))
    return p.select("a", "b", sim.label_similarity(F.col("a"), F.col("b")).alias("s"))


#: Golden entities: a name of a type, with the smallest key.
TYPED = "(SELECT p_type AS t, p_name AS n, min(p_partkey) AS k FROM part GROUP BY 1, 2)"


def typed_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").groupBy(F.col("p_type").alias("t"), F.col("p_name").alias("n")).agg(F.min("p_partkey").alias("k"))


@q("SIM-04", "JN-07", "PL-02", oracle=f"""
WITH p AS (
  SELECT a.t AS type, least(a.k, b.k) AS ka, greatest(a.k, b.k) AS kb, a.n AS a, b.n AS b, CAST(levenshtein(a.n, b.n) AS INTEGER) AS distance, least(length(a.n), length(b.n)) AS short,
         len(list_intersect({_W.format('a.n')}, {_W.format('b.n')})) / least(len({_W.format('a.n')}), len({_W.format('b.n')})) AS shared
  FROM {TYPED} a JOIN {TYPED} b ON a.t = b.t AND a.k < b.k
), s AS (
  SELECT *, CASE WHEN short < 4 AND (starts_with(a, b) OR starts_with(b, a)) THEN 0
                 WHEN short <= 5 THEN 1 - distance / short ELSE 0.6 * (1 - distance / short) + 0.4 * shared END AS confidence FROM p WHERE distance BETWEEN 1 AND 3
)
SELECT type, ka, kb, a, b, distance, round(confidence, 6) AS confidence FROM s WHERE confidence >= 0.5""")
def er_fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = resolve.fuzzy_pairs(typed_names(spark, d), "t", "n", "k", 3, 0.5)
    return p.select(F.col("t").alias("type"), "ka", "kb", "a", "b", "distance", F.round("confidence", 6).alias("confidence"))


@q("PL-02", "GR-17", oracle=f"""
WITH RECURSIVE e AS (SELECT a.k AS x, b.k AS y FROM {TYPED} a JOIN {TYPED} b ON a.t = b.t AND a.k <> b.k AND levenshtein(a.n, b.n) <= 3),
w AS (SELECT k AS s, k AS t FROM {TYPED} UNION SELECT s, e.y FROM w JOIN e ON w.t = e.x), c AS (SELECT s, min(t) AS c FROM w GROUP BY 1)
SELECT c AS component, count(*) AS members, string_agg(n, '|' ORDER BY n) AS aliases, max_by(n, (length(n) * 1000) + rk) AS name
FROM (SELECT c.c, n.n, dense_rank() OVER (ORDER BY n.n) AS rk FROM c JOIN {TYPED} n ON c.s = n.k) GROUP BY 1 HAVING count(*) > 1""")
def er_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = typed_names(spark, d)
    pairs = resolve.fuzzy_blocks(n, "t", "n", "k", 3)
    c = connected_components(pairs, cut, "ka", "kb")
    g = resolve.cluster_primary(c.join(n, c.node == n.k), "component", "n")
    return g.select("component", "members", F.array_join("aliases", "|").alias("aliases"), "name")


@q("SIM-06", oracle="""
WITH s AS (SELECT n_regionkey AS r, list(DISTINCT left(n_name, 2)) AS v FROM nation GROUP BY 1)
SELECT a.r AS a, b.r AS b, round(0.6 * len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))) + 0.4 * (1 - abs(len(a.v) - len(b.v)) / greatest(len(a.v), len(b.v))), 6) AS s FROM s a JOIN s b ON a.r < b.r""")
def sim_signature(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("a")).agg(F.collect_set(F.left("n_name", F.lit(2))).alias("v"))
    j = s.join(s.select(F.col("a").alias("b"), F.col("v").alias("w")), F.col("a") < F.col("b"))
    return j.select("a", "b", F.round(sim.signature_similarity(F.col("v"), F.col("w")), 6).alias("s"))


# --- vectors ----------------------------------------------------------------------------------------

_D = "CAST(embedding AS DOUBLE[])"


@q("VEC-01", "VEC-02", "D14", oracle=f"""
WITH q AS (SELECT {_D} AS v FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_cosine_similarity({_D}, q.v), 6) AS cosine, round(list_inner_product({_D}, q.v), 6) AS dot, round(list_distance({_D}, q.v), 6) AS l2 FROM embeddings, q WHERE vec_id <> 7 ORDER BY list_inner_product({_D}, q.v) DESC, vec_id LIMIT 20""")
def vec_top_k(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    v = e.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    s = e.filter("vec_id <> 7").crossJoin(F.broadcast(v))  # one row
    a, b = F.col("embedding"), F.col("q")
    top = s.withColumn("_dot", A.dot(a, b)).orderBy(F.desc("_dot"), "vec_id").limit(20)
    return top.select("vec_id", F.round(A.cosine(a, b), 6).alias("cosine"), F.round("_dot", 6).alias("dot"), F.round(A.l2_distance(a, b), 6).alias("l2"))


@q("JN-12", "PL-08", oracle=f"""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.label < 5 AND b.label >= 5 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3""")
def vec_cross(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return sim.similar_pairs(e.filter("label < 5"), e.filter("label >= 5"), "vec_id", "embedding", 0.3).withColumn("score", F.round("score", 6))


# --- text -------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"


@q("TXT-01", oracle=f"SELECT item_id, CAST(len({_TOK.format('text')}) AS BIGINT) AS n, array_to_string({_TOK.format('text')}[1:5], ' ') AS head FROM benchmark")
def txt_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return load(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@q("TXT-02", oracle=f"""
WITH p AS (SELECT item_id, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' AS p FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' AS t FROM documents)
SELECT doc_id, item_id FROM d JOIN p ON contains(t, p) AND p <> '  '""")
def txt_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a whole passage of the benchmark in them."""
    return text.phrase_hits(load(spark, d, "documents"), load(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@q("TXT-04", oracle=f"""
WITH p AS (SELECT item_id, unnest({_TOK.format('text')}) AS token, len({_TOK.format('text')}) AS dl FROM benchmark), tf AS (SELECT item_id, token, dl, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1)
SELECT item_id, token, round(tf / dl * ln((SELECT count(*) FROM benchmark) / df), 6) AS tfidf FROM tf JOIN df USING (token)""")
def txt_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return text.tfidf(load(spark, d, "benchmark"), "item_id", "text").withColumn("tfidf", F.round("tfidf", 6))


@q("EXT-27", oracle="""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n, (len(w) - 1) // 350 AS last FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, i AS chunk_index, last + 1 AS total_chunks, w[i * 350 + 1 : i * 350 + 400] AS c FROM (SELECT *, unnest(range(last + 1)) AS i FROM n))
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks, CAST(len(c) AS INTEGER) AS word_count, left(sha256(array_to_string(c, ' ') || ':' || chunk_index), 16) AS chunk_key FROM c""")
def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.chunks(load(spark, d, "documents"), "doc_id", "text", 400, 50).select("doc_id", "chunk_index", "total_chunks", "word_count", "chunk_key")


@q("EXT-24", oracle=f"""
WITH t AS (SELECT DISTINCT page_id, unnest({_TOK.format('html')}) AS token FROM pages), n AS (SELECT DISTINCT n_name, unnest({_TOK.format("replace(n_name, '_', ' ')")}) AS token FROM (SELECT unnest(['for the nav', 'script track', 'error page', 'reed']) AS n_name))
SELECT page_id, n_name, count(*) AS score FROM t JOIN n USING (token) WHERE length(token) >= 3 GROUP BY 1, 2""")
def txt_mentions(spark: SparkSession, d: str) -> DataFrame:
    n = spark.createDataFrame([("for the nav",), ("script track",), ("error page",), ("reed",)], "n_name string")
    return text.mentions(load(spark, d, "pages"), n, "page_id", "html", "n_name")


# --- bridging and retrieval ---------------------------------------------------------------------------


@q("PL-03", "PL-04", "WN-01", oracle=f"""
WITH i AS (SELECT DISTINCT p_name AS item FROM part), c AS (SELECT DISTINCT p_type AS cand FROM part), s AS (SELECT item, cand, greatest(1 - levenshtein(item, lower(cand)) / greatest(length(item), length(cand)), CASE WHEN item = lower(cand) THEN 0.95 WHEN starts_with(item, lower(cand)) THEN 0.85 WHEN contains(item, left(lower(cand), 2)) THEN 0.80 ELSE 0 END) AS score FROM i, c),
g AS (SELECT item, cand, least(CASE WHEN length(cand) % 2 = 0 THEN score * 1.2 ELSE score * 0.95 END, 1.0) AS score FROM s)
SELECT item, cand, round(score, 6) AS score, round(score - coalesce(nxt, 0), 6) AS margin FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY item ORDER BY score DESC, cand)) WHERE r = 1 AND score >= 0.3""")
def br_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Names to types: similarity, floors by kind of match, a boost from the graph, the best one with its margin."""
    p = load(spark, d, "part")
    c = p.select(F.col("p_name").alias("item")).distinct().crossJoin(p.select(F.col("p_type").alias("cand")).distinct())  # a handful of types; every pair is scored
    i, t = F.col("item"), F.lower("cand")
    s = resolve.bridge_score(sim.lev_ratio(i, t), i == t, i.startswith(t), F.contains(i, F.left(t, F.lit(2))))
    s = resolve.graph_boost(s, F.length("cand") % 2 == 0)
    return resolve.best_match(c.withColumn("score", s), "item", "score", ["cand"], 0.3).select("item", "cand", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@q("PL-06", "JN-14", oracle="""
WITH k AS (SELECT p_partkey, 1 AS prio, p_name AS key FROM part UNION ALL SELECT p_partkey, 2, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda x: x[1]), '')) FROM part UNION ALL SELECT p_partkey, 3, unnest(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4)) FROM part),
l AS (SELECT key, min(prio * 100000000 + p_partkey) % 100000000 AS target FROM k GROUP BY key) SELECT w AS word, target FROM (SELECT unnest(['gizmo', 'red anvil', 'RA', 'cold', 'nothing', 'gear']) AS w) JOIN l ON l.key = w""")
def br_exact_keys(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.strings import acronym

    p = load(spark, d, "part").select("p_partkey", "p_name")
    k = p.select("p_partkey", F.lit(1).alias("prio"), F.col("p_name").alias("key")).unionByName(p.select("p_partkey", F.lit(2).alias("prio"), acronym(F.col("p_name")).alias("key")))
    k = k.unionByName(p.select("p_partkey", F.lit(3).alias("prio"), F.explode(F.filter(F.split("p_name", " "), lambda x: F.length(x) >= 4)).alias("key")))
    want = spark.createDataFrame([(w,) for w in ("gizmo", "red anvil", "RA", "cold", "nothing", "gear")], "key string")
    best = k.join(F.broadcast(want), "key", "left_semi").groupBy("key").agg(F.min(F.struct("prio", "p_partkey"))["p_partkey"].alias("target"))
    return best.select(F.col("key").alias("word"), "target")


@q("PL-07", "WN-07", oracle=f"""
WITH s AS (SELECT a.vec_id AS item, b.label AS cand, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY item ORDER BY score DESC, cand))
SELECT item, cand, round(score, 6) AS score FROM r WHERE r = 1 AND score >= 0.25 AND (item % 3 = 0 OR (score >= 0.8 AND score - nxt >= 0.05))""")
def br_embedding_gate(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    s = sim.best_by_label(e.filter("vec_id % 50 = 0"), e.filter("vec_id % 50 <> 0"), "vec_id", "embedding", "label").select(F.col("a").alias("item"), F.col("label").alias("cand"), "score")
    best = resolve.best_match(s, "item", "score", ["cand"], 0.25)
    ok = resolve.embedding_gate(F.col("score"), F.col("margin"), (F.col("item") % 3 == 0).cast("int"), 0.25)
    return best.filter(ok).select("item", "cand", F.round("score", 6).alias("score"))


@q("PL-11", oracle=f"""
WITH q AS (SELECT {_D} AS v FROM embeddings WHERE vec_id = 3), a AS (SELECT vec_id, label, round(list_cosine_similarity({_D}, q.v), 6) AS s FROM embeddings, q ORDER BY list_cosine_similarity({_D}, q.v) DESC, vec_id LIMIT 3),
h AS (SELECT a.s, a.vec_id, d.doc_id, left(d.text, 20) AS t FROM a JOIN documents d ON d.doc_id = a.vec_id)
SELECT 'all' AS g, 'Question: what' || chr(10) || string_agg('- ' || t, chr(10) ORDER BY vec_id, doc_id) AS context FROM h""")
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """Anchors by vector, expanded to documents, as one context text."""
    e = load(spark, d, "embeddings")
    v = e.filter("vec_id = 3").select("embedding").first()["embedding"]  # the question's vector
    a = retrieve.anchors(e, "vec_id", "embedding", v, 3)
    h = a.join(load(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).withColumn("g", F.lit("all"))
    return retrieve.context_text(h, "what", "g", ["vec_id", "doc_id"], F.concat(F.lit("- "), F.left("text", F.lit(20))))
