"""How sources of a language differ in their words, counted by DuckDB in shards of (language, term).

Tasks cut texts into terms and count them by (language, source, term) before anything is shuffled; Spark adds these up,
so a shard has a row a source and term, however frequent the term is. Shards are hashes of (language, term). In each,
DuckDB first keeps the terms that enough documents of the language have; Spark adds up the totals of the groups; and
then SQL in each shard gives every kept term its share in each source, counts of 0 included, sums the differences
between any two sources of the language over the shard's terms, and ranks the shard's terms of each source. Spark
merges the sums and the rankings.

Shares are p = 1 + floor(10^9 (count + 5) / (N + 5 V)), all in whole numbers of 128 bits. A source's term value is how
far its share is above the language's, its pair value the sum of |p - q| over all kept terms.

A shard's rows are bounded by its number, which grows with the bytes of text. What goes to every shard is a row a group;
the result has one for any two of them.

Defined cases: null text, lang and source read as ''; a text without terms counts for its group only; repeated rows
count each; a language without kept terms has pairs of value 0; a single source of a language has no pairs; an empty
table gives none. Sources and languages are exact strings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lean, written

#: Bytes of text for each shard; its rows are fewer than a fifth of that.
SHARD_BYTES = 24_000_000
#: Bytes of text that terms are counted in at once.
AT_ONCE = 8_000_000
#: Memory of DuckDB in a task.
MEMORY = "320MB"
#: Bytes that belong to terms, in small letters; all others part them.
_LOWER = bytes((c + 32 if 65 <= c <= 90 else c) if (65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(texts):
    """(list array of the terms of each text of an Arrow array); only A-Z become small. There may be '' among them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    clean = memoryview(data)[at[0] : at[-1]].tobytes().translate(_LOWER) if len(texts) and data is not None else b""
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(clean))
    return pc.split_pattern(plain, " ")


def _count_terms(batches):
    """Counts of each slice: occurrences and documents by lang, source and term."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for b in chunks(batch, AT_ONCE):
            groups = pa.StructArray.from_arrays([pc.fill_null(b.column(c), "") for c in ("lang", "source")], names=["lang", "source"])
            key = pc.binary_join_element_wise(pc.cast(pc.utf8_length(groups.field("lang")), pa.string()), groups.field("lang"), groups.field("source"), ":").dictionary_encode()
            cut = terms_of(b.column("text"))
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
            coded = cut.flatten().dictionary_encode()
            term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = coded.dictionary
            some = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[term] if len(term) else np.zeros(0, bool)
            term, of = term[some], of[some]
            group = key.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            seen, n = np.unique(of * len(names) + term, return_counts=True)  # documents and their terms
            pair = group[seen // max(1, len(names))] * len(names) + seen % max(1, len(names))
            found, back = np.unique(pair, return_inverse=True)
            counts = np.bincount(back, weights=n, minlength=len(found)).astype(np.int64)  # exact: a slice has fewer than 2 ** 53 terms
            docs = np.bincount(back, minlength=len(found))
            first = np.zeros(len(key.dictionary), np.int64)
            first[group[::-1]] = np.arange(b.num_rows)[::-1]
            rows = groups.take(pa.array(first[found // max(1, len(names))]))
            yield pa.RecordBatch.from_arrays([rows.field("lang"), rows.field("source"), names.take(pa.array(found % max(1, len(names)))).cast(pa.string()), pa.array(counts), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def _database():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})


def _kept_in_shard(least: int):
    def run(shard):
        with _database() as db:
            db.register("shard", shard)
            return db.sql(f"""
                WITH terms AS (SELECT lang, term FROM shard GROUP BY lang, term HAVING sum(docs) >= {least})
                SELECT s.shard, lang, term, source, n, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS BIGINT) AS is_first
                FROM shard s JOIN terms USING (lang, term)""").to_arrow_table()

    return run


#: Of one shard's kept rows and all groups: partial sums of pairs, and the first ranks of terms. The share of count c in
#: a group of N occurrences is share(c, N, V).
_DIVERGE = """
WITH kept AS (SELECT lang, term, source, n FROM shard), v AS (SELECT lang, term, sum(n) AS n FROM kept GROUP BY lang, term),
dense AS (
  SELECT v.lang, v.term, g.source, coalesce(k.n, 0) AS n, share(coalesce(k.n, 0), g.total, g.terms) AS p, share(v.n, g.lang_total, g.terms) AS q
  FROM v JOIN groups g ON v.lang = g.lang LEFT JOIN kept k ON k.lang = v.lang AND k.term = v.term AND k.source = g.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
), ranked AS (
  SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r
  FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM ranked WHERE r <= {top}
"""
_SHARE = "CREATE MACRO share(c, total, terms) AS 1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (CAST(total AS HUGEINT) + 5 * terms)"
_FOUND = "lang string, source string, part string, item string, value long"


def _diverge_in_shard(top: int):
    def run(shard, groups):
        with _database() as db:
            db.register("shard", shard)
            db.register("groups", groups)
            db.execute(_SHARE)
            return db.sql(_DIVERGE.format(top=top)).to_arrow_table()

    return run


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of ``docs`` (text, lang, source) differs from the others."""
    d = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    groups = written(d.groupBy("lang", "source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")), "divergence-groups")
    n_shards = max(1, -(-(groups.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))

    counts = d.mapInArrow(lean(_count_terms), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(n_shards)).cast("int")
    kept = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(_kept_in_shard(least), "shard int, lang string, term string, source string, n long, is_first long")
    kept = written(kept, "divergence-kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("is_first").alias("terms"))
    of_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("terms"))
    groups = groups.select("lang", "source").join(sums.drop("terms"), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    groups = written(groups, "divergence-totals")
    every = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    found = kept.drop("is_first").groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(_diverge_in_shard(top), _FOUND)
    found = written(found, "divergence-found")

    half = found.filter(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_item"))  # all pairs of sources are the result
    pairs = groups.select("lang", "source").join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("_item"))).select("lang", "source", F.col("_item").alias("item"))
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    terms = ranked(found.filter(F.col("part") == "term")).filter(F.col("rank") <= top)
    return ranked(pairs).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
