"""A stored index for text search: positional postings in blocks of documents, each with the most that it can score.

Documents are dealt into blocks by their key's hash; that moves each text once, and all else is made where it lands.
The index has a row for each token and block: how many documents of the block have the token, the greatest BM25 weight
among them, and the postings themselves, with positions. Tokens of queries are sent to the index, where they are
counted and not too many, so the index isn't shuffled but for the postings that they need. A query
reads the heads of its tokens first, without postings: a block can't score more than the sum of its tokens' best
weights. The blocks that promise most are scored exactly, their k-th best score is a floor, and only blocks that can
reach it are read besides. The result is that of scoring every document.

Phrases are looked for in blocks that have all of their tokens, by positions, from the rarest token on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyzers import text_tokens

#: Documents of a block.
BLOCK = 64
#: Tokens that a task indexes, about.
PART = 1_000_000
K1, B = 1.2, 0.75
#: Rows of queries' tokens up to which they are sent to the index.
SENT = 1_000_000
#: Scores that are less below a floor may round to it.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """``rows`` is (token, block, df, best, posts array of (key, tf, dl), positions, an array for each of the posts), by
    tokens; the rest are totals."""

    rows: DataFrame
    documents: int
    average: float
    blocks: int
    analyzer: Callable[[Column], Column]
    k1: float
    b: float

    def heads(self, tokens: DataFrame) -> DataFrame:
        """(token, block, df, best) of some tokens; the stored postings aren't read."""
        return self.rows.select("token", "block", "df", "best").join(sent(tokens.select("token").distinct()), "token")


def sent(few: DataFrame) -> DataFrame:
    """A frame of queries or their tokens, broadcast if its rows, counted first, are not too many."""
    return F.broadcast(few) if few.limit(SENT + 1).count() <= SENT else few


def weight(tf: Column, dl: Column, average: float, k1: float, b: float) -> Column:
    """What a token adds to a document's BM25 score, but for its rarity."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(float(average or 1))))


def rarity(df: Column, documents: int) -> Column:
    return F.log(1 + (F.lit(documents) - df + 0.5) / (df + 0.5))


def build(docs: DataFrame, key: str, text: str, path: str, analyzer: Callable[[Column], Column] = text_tokens, k1: float = K1, b: float = B) -> Index:
    """Write the index of ``docs`` to ``path``. Documents without text count as empty ones."""
    spark = docs.sparkSession
    t = docs.select(F.col(key).alias("key"), F.coalesce(analyzer(F.col(text)), F.array().cast("array<string>")).alias("_t")).withColumn("dl", F.size("_t"))
    n, average = t.agg(F.count("*"), F.avg("dl")).first()
    blocks = max(1, -(-n // BLOCK))
    parts = min(blocks, max(spark.sparkContext.defaultParallelism, math.ceil(n * (average or 0) / PART)))
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("_x")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).repartition(parts, "block")
    t = d.select("block", "key", F.coalesce(analyzer(F.col("_x")), F.array().cast("array<string>")).alias("_t")).withColumn("dl", F.size("_t"))
    posts = t.select("block", "key", "dl", F.posexplode("_t").alias("pos", "token")).groupBy("block", "key", "token").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))
    posts = posts.withColumn("tf", F.size("positions"))
    rows = posts.groupBy("block", "token").agg(F.count("*").alias("df"), F.max(weight(F.col("tf"), F.col("dl"), average, k1, b)).alias("best"), F.collect_list(F.struct("key", "tf", "dl", "positions")).alias("_p"))
    apart = F.transform("_p", lambda x: F.struct(x["key"].alias("key"), x["tf"].alias("tf"), x["dl"].alias("dl")))
    rows = rows.select("token", "block", "df", "best", apart.alias("posts"), F.transform("_p", lambda x: x["positions"]).alias("positions"))
    rows.sortWithinPartitions("token", "block").write.parquet(path)
    return Index(spark.read.schema(rows.schema).parquet(path), n, average or 0.0, blocks, analyzer, k1, b)


def terms(index: Index, queries: DataFrame, query: str, text: str, boost: str | None = None) -> DataFrame:
    """(query, token, boost) of ``queries``: each token of a query's text once, with the row's boost."""
    b = F.col(boost).cast("double") if boost else F.lit(1.0)
    return queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(index.analyzer(F.col(text)))).alias("token"), b.alias("boost")).groupBy("query", "token").agg(F.max("boost").alias("boost"))


def _scored(index: Index, tokens: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query, key, score, matched) of all documents in ``blocks`` (query, block), by ``tokens`` (query, token, gain).

    Where the blocks are too many to be sent to the index, the postings of the tokens are shuffled by block, once for
    all queries, and documents are summed up where they land.
    """
    chosen = blocks.groupBy("block").agg(F.collect_set("query").alias("_queries"))
    if blocks.limit(SENT + 1).count() <= SENT:
        chosen = F.broadcast(chosen)
    p = index.rows.select("token", "block", "posts").join(sent(tokens.select("token").distinct()), "token", "left_semi").join(chosen, "block")
    p = p.join(sent(tokens), "token").filter(F.array_contains("_queries", F.col("query"))).select("query", "block", "gain", F.explode("posts").alias("p")).select("query", "block", "gain", "p.key", "p.tf", "p.dl")
    s = p.withColumn("_s", F.col("gain") * weight(F.col("tf"), F.col("dl"), index.average, index.k1, index.b))
    return s.groupBy("query", "block", "key").agg(F.sum("_s").alias("score"), F.count("*").alias("matched"))


def top_k(index: Index, wanted: DataFrame, k: int, keep, least: int = 1, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best documents of each query of ``wanted`` (query, token, boost), and how much of the index was read.

    A document must have ``least`` of a query's tokens. Scores are rounded to ``digits``, ties go to the smaller key.
    The first frame is (query, key, score, rank), the second (query, blocks, read).
    """
    heads = index.heads(wanted)
    df = heads.groupBy("token").agg(F.sum("df").alias("_df"))
    tokens = keep(wanted.join(df, "token").select("query", "token", (F.col("boost") * rarity(F.col("_df"), index.documents)).alias("gain")), "tokens")
    met = index.rows.select("token", "block", "best").join(sent(tokens), "token")
    promise = met.groupBy("query", "block").agg(F.sum(F.col("gain") * F.col("best")).alias("most"), F.count("*").alias("tokens")).filter(F.col("tokens") >= least)
    first = Window.partitionBy("query").orderBy(F.desc("most"), "block")
    promise = keep(promise.withColumn("_r", F.row_number().over(first)), "promise")
    some = k  # the k blocks that promise most may have a good document each
    score = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")

    def found(blocks: DataFrame, floors: DataFrame | None = None) -> DataFrame:
        hits = _scored(index, tokens, blocks).filter(F.col("matched") >= least).withColumn("score", score(F.col("score")))
        if floors is not None:
            hits = hits.join(floors, "query", "left").filter(F.col("floor").isNull() | (F.col("score") >= F.col("floor")))
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "key", "score", "rank")

    early = keep(found(promise.filter(F.col("_r") <= some)), "early")
    floors = sent(early.filter(F.col("rank") == k).select("query", F.col("score").alias("floor")))
    promise = promise.join(floors, "query", "left").withColumn("later", (F.col("_r") > some) & (F.col("floor").isNull() | (F.col("most") >= F.col("floor") - SLACK * (1 + F.abs("floor")))))
    promise = keep(promise, "later")
    late = found(promise.filter("later"), floors)
    both = early.unionByName(late).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return both, promise.groupBy("query").agg(F.count("*").alias("blocks"), F.count_if(F.col("later") | (F.col("_r") <= some)).alias("read"))


def min_match(index: Index, wanted: DataFrame, least: int) -> DataFrame:
    """(query, key, matched): documents that have ``least`` or more of a query's tokens."""
    heads = index.heads(wanted)
    blocks = wanted.join(heads, "token").groupBy("query", "block").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    p = index.rows.select("token", "block", F.explode(F.transform("posts", lambda x: x["key"])).alias("key"))
    hits = wanted.select("query", "token").join(p, "token").join(blocks.select("query", "block"), ["query", "block"], "left_semi")
    return hits.groupBy("query", "key").agg(F.count("*").alias("matched")).filter(F.col("matched") >= least)


def phrases(index: Index, queries: DataFrame, query: str, text: str, keep=lambda df, name: df) -> DataFrame:
    """(query, key, times): documents with all tokens of a query's text next to each other, in order."""
    q = keep(queries.select(F.col(query).alias("query"), F.posexplode(index.analyzer(F.col(text))).alias("at", "token")), "tokens")
    size = q.groupBy("query").agg(F.count("*").alias("size"), F.countDistinct("token").alias("different"))
    words = q.select("query", "token").distinct()
    df = index.heads(words).groupBy("token").agg(F.sum("df").alias("_df"))
    rare = keep(words.join(df, "token").groupBy("query").agg(F.min(F.struct("_df", "token"))["token"].alias("token")), "rare")
    # blocks with all tokens, and their documents with the rarest one: only these are looked into
    blocks = index.rows.select("token", "block").join(sent(words), "token").groupBy("query", "block").agg(F.count("*").alias("n")).join(sent(size), "query").filter("n = different").select("query", "block")
    rarest = index.rows.select("token", "block", F.transform("posts", lambda x: x["key"]).alias("_some")).join(sent(rare), "token").select("query", "block", "_some")
    chosen = sent(keep(blocks.join(rarest, ["query", "block"]), "blocks"))
    p = index.rows.select("token", "block", "posts", "positions").join(sent(q), "token").join(chosen, ["query", "block"])
    at = F.filter(F.arrays_zip(F.transform("posts", lambda x: x["key"]).alias("key"), F.col("positions")), lambda x: F.array_contains("_some", x["key"]))
    p = p.select("query", "block", "at", F.explode(at).alias("p")).select("query", "block", "at", "p.key", F.explode("p.positions").alias("pos"))
    starts = p.select("query", "block", "key", (F.col("pos") - F.col("at")).alias("start"))
    runs = starts.groupBy("query", "block", "key", "start").agg(F.count("*").alias("n")).join(sent(size.select("query", "size")), "query").filter("n = size")
    return runs.groupBy("query", "key").agg(F.count("*").alias("times"))
