"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Every document has a size in words. Sources share ``share`` times all words by weight; no target exceeds
``cap`` times its source's words and what is cut off is shared again (water filling, in closed form over the
sorted table of sources). Targets become seats, blocks of ``block_words`` words: seats go to the highest
quotients target / (2k + 1), first among the sources, then within a source among its shards. A shard is a
seeded hash class of a source's documents, about ``shard_rows`` of them, so a hot source has many shards and
no window sees more; shards are ranked in slices of their order. Sources are ranked in one task, a row each, so
they must be fewer than the rows that a task can hold. In a shard the documents lie on a line in seeded order,
closed to a ring; its quota of blocks is an arc from a seeded start, and a document gives what of it lies on the
arc, up to ``cap`` times.

Defined cases: null text has size 0 and takes 0; null source is a source of its own, after all others; empty
tables give empty results; repeated rows and repeated doc_ids are separate documents; columns of the input
that are not named here are ignored; only ``doc_id, text, source`` are read. Same input, same seed: same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, neutral, partitions, word_count, written

WEIGHTS = (5, 2, 1)


def _ordinal(df: DataFrame) -> DataFrame:
    """Sources by code point, null last, with their weights; one row a source."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(x)) for x in WEIGHTS])
    return df.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(w) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))


def source_targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources: (source, source_size), a row a source. Adds ``weight`` and ``target`` (double).

    Sources that fill up first are those of least cap / weight. With these ahead in order, a source is capped
    if sharing what the ones before it leave, by weight among the rest, would reach its cap.
    """
    d = _ordinal(sources).withColumn("limit", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    d = d.select(
        "*",
        F.row_number().over(order).alias("_rank"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("_all"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("_filled"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_weights"),
    )
    d = d.withColumn("_level", (F.col("_all") - F.col("_filled")) / F.col("_weights"))
    d = d.withColumn("_capped", F.col("_level") * F.col("weight") >= F.col("limit"))
    # the level of the first source that isn't capped holds for all after it
    d = d.withColumn("_level", F.min(F.when(~F.col("_capped"), F.struct("_rank", "_level"))).over(everything)["_level"])
    target = F.when(F.col("_capped"), F.col("limit")).otherwise(F.least(F.col("_level") * F.col("weight"), F.col("limit")))
    return d.select(*sources.columns, "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _ranked(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """``df`` with ``_r``, the row's number in its group: groups of any size are numbered in slices of their order."""
    n = partitions(df.sparkSession)
    d = written(df.repartitionByRange(n, *group, *order).withColumn("_slice", F.spark_partition_id()), "mix-ranks")
    counts = d.groupBy(*group, "_slice").agg(F.count("*").alias("_rows"))  # a row a slice and group in it
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    on = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    number = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    return d.withColumn("_r", number).join(counts, on).withColumn("_r", F.col("_r") + F.col("_before")).drop("_slice", "_s", "_before", *[f"_g{i}" for i in range(len(group))])


def seats(parties: DataFrame, group: list[str], key: list[str], votes: str, total: str, slices: bool = False) -> DataFrame:
    """Sainte-Lague seats of each party: the ``total`` highest quotients votes / (2k + 1) in each group win.

    The divisor lies within votes / (total +- parties / 2), which bounds each party's seats from both sides;
    only the quotients between the bounds, about three a party, are laid out and ranked. Ties go to the
    smaller key. Adds ``seats``; parties without votes get none. ``slices``: a group may have more parties
    than one task should rank.
    """
    g = Window.partitionBy(*group)
    v, h, n = F.col(votes), F.col(total).cast("double"), F.count(F.when(F.col(votes) > 0, 1)).over(g)
    d = parties.withColumn("_share", F.when(v > 0, v * h / F.sum(votes).over(g))).withColumn("_n", n)
    slack = F.col("_n") / (2 * F.greatest(h, F.lit(1.0)))
    d = d.withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_share") * (1 - slack) - 0.5) - 1).cast("long"))
    d = d.withColumn("_hi", F.least(F.col(total).cast("long"), F.ceil(F.col("_share") * (1 + slack) + 0.5) + 1).cast("long"))
    d = d.withColumn("_left", F.col(total) - F.sum("_lo").over(g))
    open_ = d.filter(F.col("_hi") > F.col("_lo")).select(*group, *key, "_left", v.alias("_v"), F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_k"))
    order = [F.desc("_quotient"), *[F.col(k).asc_nulls_last() for k in key], F.asc("_k")]
    open_ = open_.withColumn("_quotient", F.col("_v") / (2 * F.col("_k") + 1))
    ranked = _ranked(open_, group, order) if slices else open_.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    won = ranked.filter(F.col("_r") <= F.col("_left"))
    won = won.groupBy(*[F.col(c).alias(f"_w{i}") for i, c in enumerate([*group, *key])]).agg(F.count("*").alias("_won"))
    on = None
    for i, c in enumerate([*group, *key]):
        on = F.col(c).eqNullSafe(F.col(f"_w{i}")) if on is None else on & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    out = d.join(won, on, "left")
    return out.select(*parties.columns, (F.coalesce("_lo", F.lit(0)) + F.coalesce("_won", F.lit(0))).alias("seats"))


def _unit(*cols: Column) -> Column:
    """A seeded number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def _sized(docs: DataFrame, seed: int, *columns: str) -> DataFrame:
    """``_key`` stands for the source, null apart from any string; ``_mix`` is the seeded order."""
    return docs.select(
        *columns, word_count(F.col("text")).alias("_size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_mix"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_key"),
    )


def _small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A written table, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= limit else df


def _arcs(sized: DataFrame, share: float, cap: int, block_words: int, shard_rows: int, seed: int, rows: DataFrame) -> DataFrame:
    """``rows`` with what each takes; quotas come from ``sized``, the same rows without the columns that aren't needed for them."""
    per = written(sized.groupBy("_key", "source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows")), "mix-sources")
    targets = source_targets(per.select("source", "source_size", "_key"), share, cap)
    per = per.select("_key", "source", "source_size", F.ceil(F.col("_rows") / shard_rows).cast("long").alias("_shards")).join(targets.select("_key", "target"), "_key")
    per = per.withColumn("_blocks", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")).withColumn("_one", F.lit(1))
    sources = seats(per, ["_one"], ["_key"], "target", "_blocks").select("_key", "source_size", "target", "_shards", F.col("seats").alias("_seats"))
    sources = _small(written(sources, "mix-targets"))

    def placed(d: DataFrame) -> DataFrame:
        return d.join(sources, "_key").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_mix"), F.col("_shards")))

    shards = placed(sized).groupBy("_key", "shard", "_seats").agg(F.sum("_size").alias("shard_size"))
    shards = seats(shards, ["_key"], ["shard"], "shard_size", "_seats", slices=True)
    shards = _small(written(shards.select("_key", "shard", "shard_size", (F.col("seats") * block_words).alias("_quota")), "mix-shards"))

    line = Window.partitionBy("_key", "shard").orderBy("_mix", "doc_id", "_size")
    d = placed(rows).join(shards, ["_key", "shard"])
    d = d.withColumn("_end", F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # the ring is turned so that the arc starts at 0; a document's first word then lies at _at
    size, ring = F.col("_size"), F.col("shard_size")
    turn = F.floor(_unit(F.lit(seed + 2), "_key", "shard") * ring).cast("long")
    quota = F.least(F.col("_quota"), F.lit(cap) * ring)
    d = d.withColumn("_at", F.when(ring > 0, F.pmod(F.col("_end") - size - turn, ring)).otherwise(0))
    d = d.withColumn("_full", F.when(ring > 0, F.floor(quota / ring)).otherwise(0).cast("long"))
    rest = quota - F.col("_full") * ring
    to_end = F.least(size, ring - F.col("_at"))
    d = d.withColumn("_to_end", to_end).withColumn("_head", F.greatest(F.lit(0), F.least(to_end, rest - F.col("_at"))))
    d = d.withColumn("_tail", F.greatest(F.lit(0), F.least(size - F.col("_to_end"), rest)))  # of a document that lies over the start
    d = d.withColumn("_arc", (F.col("_head") + F.col("_tail")).cast("long"))
    return d.withColumn("_from", F.when(F.col("_tail") > 0, F.col("_to_end")).otherwise(0).cast("long"))


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, block_words: int = 16, shard_rows: int = 4096, seed: int = 7) -> DataFrame:
    """A row for every document: doc_id, source, size, source_size, target, taken, shard, arc_from, arc_words.

    ``arc_from`` and ``arc_words`` say which words of the document lie on the arc beyond the whole copies:
    arc_words of them from word arc_from on, going on at the first after the last.
    """
    sized = written(_sized(docs, seed, "doc_id", "source"), "mix-sizes")
    d = _arcs(sized, share, cap, block_words, shard_rows, seed, sized)
    return d.select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("_full") * F.col("_size") + F.col("_arc")).alias("taken"),
        "shard", F.col("_from").alias("arc_from"), F.col("_arc").alias("arc_words"),
    )


def words_between(text: Column, start: Column, n: Column) -> Column:
    """n words of a text from word ``start`` on, joined by single spaces."""
    w = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.concat_ws(" ", F.slice(w, (start + 1).cast("int"), n.cast("int")))


def mixed_documents(docs: DataFrame, share: float = 1.5, cap: int = 2, block_words: int = 16, shard_rows: int = 4096, seed: int = 7) -> DataFrame:
    """The mix itself, in the columns of ``docs``: whole copies of each document and the part of it on the arc.

    Whole copies keep their text as it is; a part is its words in their order, joined by single spaces, and
    ``n_chars``, if there is such a column, is counted again. A document that has both ends on the arc, but not
    what is between them, gives a row for each end. Documents of which nothing is taken go. Other columns may
    have any names.
    """
    d, names = neutral(docs, ("doc_id", "text", "source", "n_chars"))
    sized = written(_sized(d, seed, "doc_id", "source"), "mix-sizes")
    d = _arcs(sized, share, cap, block_words, shard_rows, seed, _sized(d, seed, *d.columns))
    size = F.col("_size")
    piece = lambda a, n: F.struct(a.cast("long").alias("a"), n.cast("long").alias("n"))
    full = F.col("_full") + F.when(F.col("_arc") == size, 1).otherwise(0)
    whole = F.array_repeat(piece(F.lit(0), size), full.cast("int"))
    ends = F.array(piece(F.lit(0), F.col("_head")), piece(F.col("_to_end"), F.col("_tail")))
    # nothing lies between a head up to the ring's end and the tail after it, so these are one part
    joined = F.array(piece(F.lit(0), F.col("_head") + F.col("_tail")))
    part = F.when(F.col("_arc") == size, F.slice(ends, 1, 0)).when(F.col("_head") == F.col("_to_end"), joined).otherwise(ends)
    d = d.withColumn("_piece", F.explode(F.filter(F.concat(whole, part), lambda x: x.n > 0)))
    is_whole = F.col("_piece.n") == size
    out = {"text": F.when(is_whole, F.col("text")).otherwise(words_between(F.col("text"), F.col("_piece.a"), F.col("_piece.n")))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(is_whole, F.col("n_chars")).otherwise(F.length(out["text"]).cast(docs.schema["n_chars"].dataType))
    return d.select(*[(out[c] if c in out else F.col(n)).alias(c) for c, n in names.items()])
