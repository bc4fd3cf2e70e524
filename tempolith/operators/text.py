"""Tokens, postings, TF-IDF, phrases, chunks, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Small letters and digits; everything else separates. No stemming, no stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 0)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf, dl): counts in each document, and its length in tokens."""
    t = docs.select(key, tokens(F.col(text)).alias("_t")).withColumn("dl", F.size("_t"))
    return t.select(key, "dl", F.explode("_t").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tfidf) with tf / length * ln(n / df)."""
    p = postings(docs, key, text)
    n = docs.agg(F.count("*").alias("n"))
    df = p.groupBy("token").agg(F.count("*").alias("df"))
    return p.join(df, "token").crossJoin(F.broadcast(n)).select(key, "token", (F.col("tf") / F.col("dl") * F.log(F.col("n") / F.col("df"))).alias("tfidf"))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase's tokens stand next to each other in the text."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return F.contains(line(text), line(phrase)) & (F.size(tokens(phrase)) > 0)


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str) -> DataFrame:
    """(document, phrase) of all whole phrases that a document has, token by token.

    A phrase meets the documents that have the rarest of its tokens, by an equi-join; then it is looked for.
    """
    line = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    d = docs.select(F.col(key).alias("_d"), tokens(F.col(text)).alias("_t"))
    p = phrases.select(F.col(phrase_key).alias("_p"), tokens(F.col(phrase)).alias("_w"))
    words_ = p.select("_p", F.explode(F.array_distinct("_w")).alias("token"))
    posts = d.select("_d", F.explode(F.array_distinct("_t")).alias("token")).join(words_.select("token").distinct(), "token", "left_semi")
    df = posts.groupBy("token").agg(F.count("*").alias("df"))
    # a token that no document has rules its phrase out
    rare = words_.join(df, "token", "left").groupBy("_p").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("_r"))
    rare = rare.filter("_r.df > 0").select("_p", F.col("_r.token").alias("token")).join(p.select("_p", line(F.col("_w")).alias("_line")), "_p")
    met = posts.join(rare, "token").select("_d", "_p", "_line")
    hit = met.join(d.select("_d", line(F.col("_t")).alias("_text")), "_d").filter(F.contains("_text", "_line"))
    return hit.select(F.col("_d").alias(key), F.col("_p").alias(phrase_key)).distinct()


def top_per(df: DataFrame, by: list[str], score: str, ties: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def chunks(docs: DataFrame, key: str, text: str, size: int = 400, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` words, each ``size - overlap`` after the one before it, with a key from the content.

    Windows begin until the words end, so the last ones may repeat the end of those before. ``section_header`` is
    the first of a chunk's first five lines that is a heading.
    """
    step = max(1, size - overlap)
    w = docs.select(key, F.filter(F.split(F.col(text), r"\s+"), lambda t: F.length(t) > 0).alias("_w")).withColumn("_n", F.size("_w")).filter("_n > 0")
    starts = F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step))
    c = w.select(key, "_n", F.size(starts).alias("total_chunks"), F.posexplode(F.transform(starts, lambda s: F.slice("_w", s + 1, F.lit(size)))).alias("chunk_index", "_c"))
    c = c.select(key, "chunk_index", "total_chunks", F.size("_c").alias("word_count"), F.array_join("_c", " ").alias("text"))
    c = c.withColumn("chunk_key", F.substring(F.sha2(F.concat_ws(":", "text", "chunk_index"), 256), 1, 16))
    return c.withColumn("section_header", section_header(F.col("text")))


def section_header(text: Column) -> Column:
    """The first of the first five lines that is a heading: one to four # and a title, or a number and a capital."""
    lines = F.transform(F.slice(F.split(F.trim(text), "\\R"), 1, 5), lambda t: F.trim(t))
    found = F.try_element_at(F.filter(lines, lambda t: t.rlike(r"^#{1,4}\s+\S|^\d+(\.\d+)*\s+[A-Z]")), F.lit(1))
    return F.when(found.startswith("#"), F.trim(F.regexp_replace(found, "^#+", ""))).otherwise(found)


def mentions(docs: DataFrame, names: DataFrame, key: str, text: str, name: str, least: int = 3) -> DataFrame:
    """(key, name, score): names whose words, of ``least`` characters or more, are in a document as whole words.

    Names are one token each here, so the match is an equi-join on tokens; score counts the distinct terms.
    """
    t = docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    n = names.select(name, F.explode(F.array_distinct(F.filter(tokens(F.col(name)), lambda x: F.length(x) >= least))).alias("token"))
    return t.join(n, "token").groupBy(key, name).agg(F.count("*").alias("score"))
