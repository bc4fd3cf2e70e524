"""Packing documents into sequences of at most ``capacity`` tokens by cutting-stock column generation.

A document of n ids gives n // capacity sequences that it fills alone, and a rest. Rests are classed by length
(``unit`` tokens a class). From the histogram of classes, which has a fixed size, the driver solves the
cutting-stock linear program and rounds its patterns down. Rests are ranked within their class, and the rank
alone says which slot of which sequence a rest gets. Rests beyond the ranks that the patterns take are laid end
to end and cut to fill the gaps of the sequences exactly, then cut into full sequences; what is left at the end
goes into sequences of powers of two. So no sequence has padding, and only these last rests are cut.

Ranks and offsets are sums over (partition, class) and running sums within a partition, so that no class, and
no run of equal lengths, meets in one task. Ids are encoded once, in a table in the shared folder.

Defined cases: null text is empty and has its end id only; rows with null or repeated doc_id are documents of
their own, told apart by ``row``; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cutting, tokens
from .common import lean, scratch, written

ENCODED = "part int, row long, doc_id long, n long, class int, rank long, full_before long, crcs array<long>, ids binary"


def _encode(vocabulary: str, end_id: int, capacity: int, unit: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        t = tokens.cached_tokenizer(vocabulary)
        narrow = t.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        ranks, full, row = np.zeros(-(-capacity // unit) + 1, dtype=np.int64), 0, 0
        for b in batches:
            for first, ids, n in t.batches(b.column("text")):
                ids, n = tokens.with_end(ids, n, end_id)
                m, ends = len(n), np.concatenate([[0], np.cumsum(n)])
                classes = -(-(n % capacity) // unit)  # 0: no rest
                rank = np.zeros(m, np.int64)
                for k in np.unique(classes):
                    at = np.flatnonzero(classes == k)
                    rank[at] = ranks[k] + np.arange(len(at))
                    ranks[k] += len(at)
                fills = n // capacity
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crcs = [[zlib.crc32(data[4 * x : 4 * min(x + capacity, z)]) for x in range(a, z, capacity)] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
                kept = ids.astype("<u2" if narrow else "<u4", copy=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, part, np.int32)), pa.array(row + np.arange(m)), b.column("doc_id").slice(first, m).cast(pa.int64()), pa.array(n), pa.array(classes.astype(np.int32)), pa.array(rank),
                     pa.array(full + np.cumsum(fills) - fills), pa.array(crcs, pa.list_(pa.int64())), _binary(kept, ends)],
                    names=["part", "row", "doc_id", "n", "class", "rank", "full_before", "crcs", "ids"],
                )
                full += int(fills.sum())
                row += m

    return run


def _binary(values: np.ndarray, ends: np.ndarray):
    """An Arrow array of the bytes of ranges of values."""
    import pyarrow as pa

    at = pa.py_buffer(ends * values.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, at, pa.py_buffer(values)]).cast(pa.binary())


def _slots(patterns: np.ndarray, counts: np.ndarray) -> list[dict]:
    """For each class and pattern: the first rank that goes there, how many a sequence, and the first sequence."""
    first = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for k in range(patterns.shape[1]):
        at = 0
        for p in np.flatnonzero((patterns[:, k] > 0) & (counts > 0)):
            n = int(patterns[p, k] * counts[p])
            out.append({"class": k + 1, "from_rank": at, "to_rank": at + n, "each": int(patterns[p, k]), "first": int(first[p])})
            at += n
    return out


def _running(df: DataFrame, value: str, name: str, block: str, order: list[str]) -> DataFrame:
    """Sum of ``value`` over all rows before each, by block and then in a block; blocks are of bounded size."""
    sums = df.groupBy(block).agg(F.sum(value).alias("_sum"))
    base = sums.select(F.col(block).alias("_b"), F.coalesce(F.sum("_sum").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.join(base, F.col(block) == F.col("_b"))
    return d.withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_b", "_base")


def _cut_tasks(batches):
    import pyarrow as pa

    names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for b in batches:
        out = {k: [] for k in names}
        for part, row, doc, n, ids, pieces in zip(*(b.column(c).to_pylist() for c in ("part", "row", "doc_id", "n", "ids", "pieces"))):
            whole = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
            for p in pieces:
                a, m = p["start"], p["length"]
                v = ((part << 36) + row, doc, a, m, zlib.crc32(whole[4 * a : 4 * (a + m)]), n, p["sequence_id"], p["offset"])
                for k, x in zip(names, v):
                    out[k].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64()) for k in names], names=names)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, unit: int = 16) -> DataFrame:
    """A row for every piece: row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    path = scratch(spark, "packing-ids")
    docs.select("doc_id", "text").mapInArrow(lean(_encode(vocabulary, end_id, capacity, unit)), ENCODED).write.parquet(path)
    encoded = spark.read.schema(ENCODED).parquet(path)
    rows = encoded.drop("ids")

    n_classes = -(-capacity // unit)
    demand = np.zeros(n_classes, dtype=np.int64)
    for r in rows.filter("class > 0").groupBy("class").count().collect():  # at most n_classes rows
        demand[r["class"] - 1] = r["count"]
    patterns, use = cutting.solve(demand, n_classes)
    counts = cutting.whole_counts(patterns, use, demand, unit, capacity) if len(use) else np.zeros(0, dtype=np.int64)
    taken = (counts @ patterns).astype(int) if len(use) else np.zeros(n_classes, dtype=int)
    n_filled = int(counts.sum())

    # ranks over all partitions; full sequences are numbered by partition, too
    by = rows.groupBy("part", "class").agg(F.count("*").alias("_n"), F.sum(F.floor(F.col("n") / capacity)).alias("_full"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # the patterns' ranks of a class are shared out among partitions by their documents, so all keep some for the gaps
    per_class = spark.createDataFrame([(k + 1, int(taken[k]), int(demand[k])) for k in range(n_classes) if demand[k]] or [], "class int, _taken long, _demand long")
    of_class = by.filter("class > 0").withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(per_class), "class")
    of_class = of_class.select("part", "class", F.expr("_taken * _before div _demand").alias("_first"), F.expr("_taken * (_before + _n) div _demand - _taken * _before div _demand").alias("_share"))
    full = by.groupBy("part").agg(F.sum("_full").alias("_f"))
    full = full.select("part", F.coalesce(F.sum("_f").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_full_base"))
    of_class = written(of_class, "packing-bases")
    placed = rows.join(full, "part").join(of_class, ["part", "class"], "left")
    placed = placed.withColumn("_in", F.coalesce(F.col("rank") < F.col("_share"), F.lit(False))).withColumn("full_before", F.col("full_before") + F.col("_full_base"))
    placed = placed.withColumn("rank", F.col("_first") + F.col("rank")).withColumn("rest", F.col("n") % capacity)
    placed = written(placed.drop("_first", "_share", "_full_base"), "packing-ranks")
    rests = placed.filter("class > 0")

    # 1. rests in the slots of patterns; the table of slots has at most n_classes ** 2 rows
    slots = spark.createDataFrame(_slots(patterns, counts) or [], "class int, from_rank long, to_rank long, each long, first long")
    slotted = rests.filter("_in").join(F.broadcast(slots), "class").filter("rank >= from_rank AND rank < to_rank")
    slotted = slotted.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each")))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("rest"), "part", "row")
    slotted = slotted.withColumn("offset", F.coalesce(F.sum("rest").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    piece = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    number = ((F.col("part").cast("long") * (1 << 36)) + F.col("row")).alias("row")
    slotted = slotted.select(number, "doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    slotted = written(slotted, "packing-slots")

    # 2. the other rests on a line
    stream = rests.filter("NOT _in").select("part", "row", (F.col("n") - F.col("rest")).alias("_doc_at"), "rest")
    stream = written(_running(stream, "rest", "u", "part", ["row"]), "packing-stream")
    total = stream.agg(F.sum("rest")).first()[0] or 0

    # 3. the gaps on a line, then full sequences, then powers of two
    gaps = slotted.groupBy("sequence_id").agg(F.sum("length").alias("filled")).withColumn("gap", F.lit(capacity) - F.col("filled")).filter("gap > 0")
    gaps = gaps.withColumn("_block", F.floor(F.col("sequence_id") / 8192))
    gaps = written(_running(gaps, "gap", "a", "_block", ["sequence_id"]).select("sequence_id", "filled", "gap", "a"), "packing-gaps")
    gap_total = gaps.agg(F.sum("gap")).first()[0] or 0
    left = max(0, total - gap_total)
    n_full, tail = divmod(left, capacity)
    wholes = spark.range(n_full).select((F.col("id") + n_filled).alias("sequence_id"), F.lit(0).cast("long").alias("filled"), F.lit(capacity).cast("long").alias("gap"), (F.col("id") * capacity + gap_total).alias("a"))
    ends, at, sid = [], gap_total + n_full * capacity, n_filled + n_full
    for bit in range(capacity.bit_length(), -1, -1):
        if tail >> bit & 1:
            ends.append((sid, 0, 1 << bit, at))
            at, sid = at + (1 << bit), sid + 1
    holes = gaps.unionByName(wholes)
    if ends:
        holes = holes.unionByName(spark.createDataFrame(ends, "sequence_id long, filled long, gap long, a long"))

    # 4. where they overlap; both lie on a grid of cells of ``capacity`` ids, two cells each at most
    def cells(df: DataFrame, at: str, n: str) -> DataFrame:
        lo, hi = F.floor(F.col(at) / capacity), F.floor((F.col(at) + F.col(n) - 1) / capacity)
        return df.withColumn("cell", F.explode(F.sequence(lo, hi)))

    j = cells(stream, "u", "rest").join(cells(holes, "a", "gap"), "cell")
    j = j.withColumn("_lo", F.greatest("u", "a")).withColumn("_hi", F.least(F.col("u") + F.col("rest"), F.col("a") + F.col("gap")))
    j = j.filter((F.col("_lo") < F.col("_hi")) & (F.floor(F.col("_lo") / capacity) == F.col("cell")))
    cut = j.select("part", "row", (F.col("_doc_at") + F.col("_lo") - F.col("u")).alias("start"), (F.col("_hi") - F.col("_lo")).alias("length"), "sequence_id", (F.col("filled") + F.col("_lo") - F.col("a")).alias("offset"))

    # 5. sequences that a document fills alone
    alone = placed.filter(F.col("n") >= capacity).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)))
    alone = alone.select(number, "doc_id", (F.col("_k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crcs")[F.col("_k").cast("int")].alias("ids_crc32"),
                         F.col("n").alias("doc_tokens"), (F.col("full_before") + F.col("_k") + sid).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # 6. checksums: whole pieces have theirs from the encoding; only documents that are cut need their ids again
    lists = cut.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    bases = F.broadcast(of_class) if of_class.count() <= 200_000 else of_class
    again = encoded.filter("class > 0").join(bases, ["part", "class"]).filter("rank >= _share")
    d = again.select("part", "row", "doc_id", "n", "ids").join(lists, ["part", "row"])
    cut = d.mapInArrow(lean(_cut_tasks), "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return slotted.select(piece).unionByName(alone.select(piece)).unionByName(cut.select(piece))
