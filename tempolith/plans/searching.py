"""Text search with a stored index, and analyzers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analyzers
from ..operators import search
from ..registry import CORE
from ..sources.shared import scratch
from ..tables import load
from .graph import cut

q = CORE.query

TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
#: BM25 of every document for every benchmark passage; boosts are 1, or 3 for every third passage.
_ALL = f"""
WITH d AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, token, dl, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token, len(t) AS dl FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, CASE WHEN item_id % 3 = 0 THEN 3.0 ELSE 1.0 END AS boost, unnest({TOK.format('text')}) AS token FROM benchmark), df AS (SELECT token, count(*) AS df FROM tf WHERE token IN (SELECT token FROM q) GROUP BY 1),
s AS (SELECT item_id, boost, doc_id, count(*) AS matched, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (token) JOIN df USING (token), n GROUP BY ALL)
"""


def passages(spark: SparkSession, d: str) -> tuple[search.Index, DataFrame]:
    """An index of all documents, and all benchmark passages as queries."""
    index = search.build(load(spark, d, "documents"), "doc_id", "text", scratch(spark, "search-index"))
    return index, load(spark, d, "benchmark")


@q("TXT-03", "WN-02", oracle=_ALL + """
SELECT item_id, doc_id, round(score, 3) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 7) DESC, doc_id) AS r FROM s) WHERE r <= 5""")
def txt_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents of each passage."""
    index, b = passages(spark, d)
    found, _ = search.top_k(index, search.terms(index, b, "item_id", "text"), 5, cut, digits=7)
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), F.round("score", 3).alias("score"), "rank")


@q("TXT-04", oracle=_ALL + """
SELECT item_id, doc_id, round(boost * score, 3) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(boost * score, 6) DESC, doc_id) AS r FROM s WHERE matched >= 20) WHERE r <= 10""")
def txt_boost_min_match(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents that have at least 20 tokens of a passage; some passages are boosted."""
    index, b = passages(spark, d)
    wanted = search.terms(index, b.withColumn("boost", F.when(F.col("item_id") % 3 == 0, 3.0).otherwise(1.0)), "item_id", "text", "boost")
    found, _ = search.top_k(index, wanted, 10, cut, least=20, digits=6)
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), F.round("score", 3).alias("score"), "rank")


@q("TXT-02", oracle=f"""
WITH d AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents), p AS (SELECT item_id, {TOK.format('text')} AS p FROM benchmark),
x AS (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS i, t FROM d)
SELECT item_id, doc_id, count(*) AS times FROM x JOIN p ON x.token = p.p[1] AND t[i : i + len(p) - 1] = p GROUP BY 1, 2""")
def txt_phrase_times(spark: SparkSession, d: str) -> DataFrame:
    """How often each passage is in each document, by positions."""
    index, b = passages(spark, d)
    return search.phrases(index, b, "item_id", "text", cut).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "times")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substring({0}, i, 3)))"


@q("TXT-04", oracle=f"""
WITH n AS (SELECT DISTINCT p_name AS n, lower(p_type) || ' ' || p_name AS t FROM part)
SELECT n, t, round(len(list_intersect({_GRAMS.format('n')}, {_GRAMS.format('t')})) / greatest(len({_GRAMS.format('n')}), len({_GRAMS.format('t')})), 6) AS similarity, len(list_intersect({_GRAMS.format('n')}, {_GRAMS.format('t')})) = len({_GRAMS.format('n')}) AS matches,
       array_to_string(list_transform(range(2, 5), lambda k: left(n, k)), '|') AS edges, len(list_filter(string_split(t, ' '), lambda x: x NOT IN ('red', 'cold'))) AS words
FROM n""")
def txt_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Character n-grams of names within types and names, first letters, and words that aren't stop words."""
    n = load(spark, d, "part").select(F.col("p_name").alias("n"), F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name")).alias("t")).distinct()
    words = analyzers.stopwords(["red", "cold"])(analyzers.pipeline(analyzers.norm(), analyzers.delimiter(" "))(F.col("t")))
    return n.select(
        "n", "t", F.round(analyzers.ngram_similarity(F.col("n"), F.col("t"), 3), 6).alias("similarity"), analyzers.ngram_match(F.col("n"), F.col("t"), 1.0, 3).alias("matches"),
        F.array_join(analyzers.edge_ngrams(2, 4)(F.col("n")), "|").alias("edges"), F.size(words).cast("long").alias("words"),
    )


@q("TXT-04", oracle="""
SELECT doc_id, (lang IS NOT NULL)::INTEGER + (n_chars > 2000)::INTEGER + coalesce(starts_with(lower(text), 'th'), false)::INTEGER + coalesce(contains(source, '1'), false)::INTEGER AS matched
FROM documents WHERE (lang IS NOT NULL)::INTEGER + (n_chars > 2000)::INTEGER + coalesce(starts_with(lower(text), 'th'), false)::INTEGER + coalesce(contains(source, '1'), false)::INTEGER >= 2""")
def txt_exists_min_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least two of four conditions hold."""
    n = analyzers.matched(analyzers.exists(F.col("lang")), F.col("n_chars") > 2000, F.startswith(F.lower("text"), F.lit("th")), F.contains("source", F.lit("1")))
    return load(spark, d, "documents").select("doc_id", n.alias("matched")).filter("matched >= 2")
