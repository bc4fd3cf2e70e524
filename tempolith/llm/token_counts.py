"""Token counts through a digest cache.

A text's key is the SHA-256 of its content, null as empty, next to the digest of the vocabulary file. Keys are
joined to the counts stored so far; one document of each key without a count is encoded, whole, and the new
counts are appended to the cache. A count depends on nothing but text and vocabulary, so no normalisation
other than null to empty is applied: it would merge texts with different counts.

The group of a key never travels: keys are reduced to the smallest document id of each before the shuffle,
and only the texts of these documents are encoded. An append that is repeated after a failure leaves equal
rows, which reading the cache merges.

Defined cases: null text counts as empty (0 tokens, 0 bytes); rows with null or repeated doc_id each get
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import lean, scratch, written

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def _encode_batches(path: str):
    def run(batches):
        import pyarrow as pa

        count = tokens.counter(path)
        seen: set[bytes] = set()  # rows that are equal in id and text stand for one
        for b in batches:
            new = [i for i, d in enumerate(b.column("digest").to_pylist()) if not (d in seen or seen.add(d))]
            b = b.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(count(b.column("text")), pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark, path: str, version: str) -> DataFrame:
    """(digest, n_tokens), a row a digest; an absent cache is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. ``cache``: a table's path, extended by the misses."""
    spark, version = docs.sparkSession, tokens.version(vocabulary)
    cache = cache or scratch(spark, "token-counts")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))

    stored = read_cache(spark, cache, version)
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("_doc")).join(stored, "digest", "left_anti")
    # the texts of these documents; an id that isn't unique brings other texts along, which the digest sorts out
    of = docs.select("doc_id", text.alias("text"))
    misses = of.join(first.select(F.coalesce("_doc", F.lit(0)).alias("_d"), F.col("_doc").isNull().alias("_null"), F.col("digest").alias("_digest")),
                     (F.coalesce("doc_id", F.lit(0)) == F.col("_d")) & (F.col("doc_id").isNull() == F.col("_null")) & (F.unhex(F.sha2("text", 256)) == F.col("_digest")))
    encoded = misses.select(F.col("_digest").alias("digest"), "text").mapInArrow(lean(_encode_batches(vocabulary)), "digest binary, n_tokens long")
    encoded.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)

    # counts as a written table: the join then is between two shuffles, of which a hot digest's can be split
    out = keyed.join(written(read_cache(spark, cache, version), "token-counts-now"), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
