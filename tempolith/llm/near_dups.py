"""Near-duplicates of word shingles by fast similarity sketching, banding and exact verification.

1. Each text's set of distinct k-word shingles is sketched (``shingles.fast_sketches``). Texts of equal sets form
   a class; its smallest doc_id stands for it, so exact copies, however many, cost one row from here on.
2. Bands of ``ROWS`` coordinates put classes into buckets. In a bucket one class is the centre: the one that
   meets most others over all its buckets, so in a family of edited copies the original tends to be it. Each
   class is compared with the centre that it shares most buckets with. Full sets confirm or reject the link.
3. Buckets that still hold more than one component are gone through for links across components. Only the
   classes outside the bucket's largest component are compared, with all others in it; where sketches four times
   as long say that a pair is over 4.5 deviations too far apart it is dropped, all others are confirmed on full sets. Work is
   dealt in blocks of ``BLOCK`` classes; buckets with very many classes outside are banded again by further
   coordinates first. No bucket is capped.
4. Components of all confirmed links give the groups.

A pair at exactly the threshold 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8, and its
longer sketches err that far with probability 3e-6; both fall steeply above the threshold.

Sets are compared as 48-bit digests of shingles. Texts are read twice: for sketches, and, of classes that
share a bucket, for sets, which go to the shared folder.

Defined cases: texts without words have no shingles and no links, and are groups of their own; rows of equal
doc_id and different texts are different documents, which a link may join; rows with null doc_id aren't linked
and are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import LEAST, chunks, lean, neutral, written

#: Coordinates of a sketch; bands of the first ROWS * BANDS of them, further ones for crowded buckets.
COORDINATES, ROWS, BANDS = 256, 4, 32
#: Classes compared side by side; classes outside the largest component from which a bucket is banded again.
BLOCK, CROWDED = 512, 4096
#: Coordinates of the longer sketches, a byte each, that classes of mixed buckets get.
FINE = 1024
#: Deviations of a sketch's estimate that a pair may lie under the threshold and still be confirmed.
DEVIATIONS = 4.5


def _digests(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128 bits a set: sums of mixed shingles, which their order doesn't change."""
    from . import shingles

    at, some = np.cumsum(n) - n, np.flatnonzero(n)
    out = np.zeros((len(n), 2), dtype=np.uint64)
    for j in range(2):
        if len(some):
            out[some, j] = np.add.reduceat(shingles.mix(h, 101 + j), at[some])
    return out


def _sketch_tasks(k: int):
    def run(batches):
        import pyarrow as pa

        from . import shingles

        for whole in batches:
            for b in chunks(whole):
                h, n = shingles.shingle_sets(b.column("text").to_pylist(), k)
                digest = _digests(h, n)
                sk = shingles.fast_sketches(h, n, COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("row_hash"), pa.array(n, pa.int64()), pa.array([r.tobytes() for r in digest], pa.binary()), pa.array([r.tobytes() for r in sk], pa.binary())],
                    names=["doc_id", "row_hash", "n_shingles", "digest", "sketch"],
                )

    return run


def _band_keys(sketches: np.ndarray, first: int, bands: int) -> np.ndarray:
    """Keys of ``bands`` bands from coordinate ``first`` on, a row a sketch."""
    from . import shingles

    use = np.ascontiguousarray(sketches[:, first : first + ROWS * bands]).view(np.uint64).reshape(len(sketches), bands)
    return shingles.mix(use ^ shingles.mix(np.arange(bands, dtype=np.uint64), 9)[None, :], 3)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, COORDINATES)


def _band_tasks(first: int, bands: int):
    """A row for each class and band: the bucket's key. A ``key`` that is there already becomes part of it."""

    def run(batches):
        import pyarrow as pa

        from . import shingles

        for b in batches:
            key = _band_keys(_sketches(b.column("sketch").to_pylist()), first, bands)
            if "key" in b.schema.names:
                key = shingles.mix(key + b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)[:, None], 4)
            doc = np.repeat(b.column("doc").to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(doc, pa.int64())], names=["key", "doc"])

    return run


def _set_tasks(k: int):
    """Sets of the texts that have the digest they are wanted for; an id that isn't unique brings others along."""

    def run(batches):
        import pyarrow as pa

        from . import shingles

        for whole in batches:
            for b in chunks(whole):
                h, n = shingles.shingle_sets(b.column("text").to_pylist(), k)
                bytes_ = np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]) if len(h) else np.zeros((0, 6), np.uint8)
                cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
                fits = pa.array([r.tobytes() == d for r, d in zip(_digests(h, n), b.column("digest").to_pylist())], pa.bool_())
                sets = pa.array([bytes_[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc").filter(fits), sets.filter(fits)], names=["doc", "set"])

    return run


def _fine_tasks(batches):
    import pyarrow as pa

    from . import shingles

    for b in batches:
        sets = [_numbers(x) for x in b.column("set").to_pylist()]
        for a in range(0, len(sets), 512):
            part = sets[a : a + 512]
            fine = shingles.fast_sketches(np.concatenate(part), np.array(list(map(len, part)), np.int64), FINE).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("doc").slice(a, 512), b.column("sketch").slice(a, 512), pa.array([r.tobytes() for r in fine], pa.binary())], names=["doc", "sketch", "fine"])


def _numbers(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel()


def _verify_tasks(percent: int):
    def run(batches):
        import pyarrow as pa

        last, numbers = None, None
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = x.as_py(), y.as_py()
                if last != y:
                    last, numbers = y, _numbers(y)
                lo, hi = sorted((len(x), len(y)))
                if 100 * lo < percent * hi:
                    ok.append(False)
                    continue
                both = len(np.intersect1d(_numbers(x), numbers, assume_unique=True))
                ok.append(100 * both >= percent * ((len(x) + len(y)) // 6 - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a")
    full = left.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(lean(_verify_tasks(percent)), "a long, b long")


def _across(least: float):
    """Pairs across components in a block: those outside the bucket's main component with everything in it.

    A pair that shares several buckets comes up in the first of them only.
    """

    def run(pdf):
        import pandas as pd

        xs, ys = [], []
        out = pdf[pdf["outside"]].sort_values("doc")
        inside = pdf[~pdf["outside"]]
        if len(out):
            # in one block of the bucket, those outside meet each other, too
            other = pd.concat([inside, out]) if out["first"].iloc[0] else inside
            a_s, b_s = (np.frombuffer(b"".join(d["fine"]), np.uint8).reshape(-1, FINE) for d in (out, other))
            a_keys, b_keys = (_band_keys(_sketches(d["sketch"]), 0, BANDS) for d in (out, other))
            key = np.int64(pdf["key"].iloc[0]).view(np.uint64)
            a_doc, b_doc, a_comp, b_comp = out["doc"].to_numpy(), other["doc"].to_numpy(), out["comp"].to_numpy(), other["comp"].to_numpy()
            within = np.concatenate([np.zeros(len(inside), bool), np.ones(len(other) - len(inside), bool)])
            for i in range(len(out)):
                near = np.flatnonzero((b_comp != a_comp[i]) & (~within | (b_doc > a_doc[i])))
                near = near[(b_s[near] == a_s[i]).mean(axis=1) >= least]
                if len(near):
                    same = b_keys[near] == a_keys[i]
                    shared = same.any(axis=1) & (a_keys[i] == key).any()  # a finer bucket has a key of its own
                    near = near[~shared | (a_keys[i][same.argmax(axis=1)] == key)]
                    xs += [a_doc[i]] * len(near)
                    ys += list(b_doc[near])
        return pd.DataFrame({"a": np.array(xs, np.int64), "b": np.array(ys, np.int64)})

    return run


def _mixed(rows: DataFrame) -> DataFrame:
    """rows (key, doc, comp) of buckets with several components, with the main one and how many lie outside it."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("_n"))
    main = per.groupBy("key").agg(F.max(F.struct("_n", "comp")).alias("_m"), F.sum("_n").alias("size"), F.count("*").alias("_comps")).filter("_comps > 1")
    main = main.select("key", F.col("_m.comp").alias("main"), "size", (F.col("size") - F.col("_m._n")).alias("n_outside"))
    return rows.join(main, "key").withColumn("outside", F.col("comp") != F.col("main"))


def _candidates(rows: DataFrame, sketches: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs across components in the buckets ``rows`` (key, doc, comp)."""
    mixed = written(_mixed(rows), "dups-mixed")
    fine = sketches.join(sets, "doc").join(mixed.select("doc").distinct(), "doc", "left_semi")
    fine = fine.select("doc", "sketch", "set").mapInArrow(lean(_fine_tasks), "doc long, sketch binary, fine binary")
    calm = mixed.filter(F.col("n_outside") <= CROWDED).select("key", "doc", "comp", "outside", "size")
    if mixed.filter(F.col("n_outside") > CROWDED).limit(1).count():
        # crowded with classes that mostly share a passage: four further coordinates each leave few of them together
        crowd = mixed.filter(F.col("n_outside") > CROWDED).select("key", "doc", "comp").join(sketches, "doc")
        bands = (COORDINATES - ROWS * BANDS) // ROWS
        finer = crowd.select("doc", "sketch", "key").mapInArrow(_band_tasks(ROWS * BANDS, bands), "key long, doc long").distinct()
        finer = _mixed(finer.join(rows.select("doc", "comp").distinct(), "doc"))
        calm = calm.unionByName(finer.select("key", "doc", "comp", "outside", "size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    calm = calm.withColumn("block", F.explode(F.when(F.col("outside"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))).withColumn("first", F.col("block") == 0)
    d = calm.join(fine, "doc").select("key", "block", "doc", "comp", "outside", "first", "sketch", "fine")
    return d.groupBy("key", "block").applyInPandas(_across(least), "a long, b long").distinct()


def _members(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, row_hash, n_shingles, digest; classes: digest, class_id, component_id, n_links)."""
    ids = F.col("doc_id").cast("long")
    base = written(
        docs.select(ids.alias("doc_id"), "text", F.xxhash64("text").alias("row_hash"))
        .mapInArrow(lean(_sketch_tasks(k)), "doc_id long, row_hash long, n_shingles long, digest binary, sketch binary"), "dups-sketches")
    # a class is the node of its smallest doc_id; of classes that share it (equal ids, different texts), one is
    # and the others are nodes of their own below all ids
    classes = base.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    clash = F.row_number().over(Window.partitionBy("class_id").orderBy("digest")) > 1
    own = F.lit(LEAST).bitwiseOR(F.shiftrightunsigned(F.xxhash64("digest"), 2))
    # a written table, so that the joins below are between two shuffles, of which a hot digest's can be split
    classes = written(classes.select("digest", "class_id", F.when(clash, own).otherwise(F.col("class_id")).alias("doc")), "dups-digests")
    reps = base.join(classes, (base.digest == classes.digest) & (base.doc_id == classes.class_id)).select("doc", base.digest, "class_id", "sketch")
    reps = written(reps.dropDuplicates(["doc"]), "dups-classes")

    rows = reps.select("doc", "sketch").mapInArrow(_band_tasks(0, BANDS), "key long, doc long")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    multi = written(rows.join(shared, "key"), "dups-buckets")

    # the centre of a bucket, and for each class the centre that it shares most buckets with
    weight = multi.groupBy("doc").agg(F.sum("n").alias("w"))
    weighed = multi.join(weight, "doc")
    centre = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("doc")).alias("d"))).alias("_c")).select("key", (-F.col("_c.d")).alias("centre"))
    met = multi.join(centre, "key").filter("doc <> centre").groupBy("doc", "centre").agg(F.count("*").alias("c"))
    best = met.groupBy("doc").agg(F.max(F.struct("c", (-F.col("centre")).alias("d"))).alias("_b")).select(F.col("doc").alias("a"), (-F.col("_b.d")).alias("b"))

    wanted = weight.select("doc")
    of = classes.join(wanted, "doc", "left_semi").select("doc", F.col("class_id").alias("_id"), "digest")
    texts = docs.select(ids.alias("_id"), "text").join(of, "_id").select("doc", "digest", "text")
    sets = texts.mapInArrow(lean(_set_tasks(k)), "doc long, set binary")
    sets = written(sets, "dups-sets")
    links = written(verify(best, sets, percent), "dups-links")
    comp = connected_components(links, written, "a", "b")

    rows = multi.select("key", "doc").join(comp, multi.doc == comp.node, "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    share = percent / 100
    least = share - DEVIATIONS * (share * (1 - share) / FINE) ** 0.5
    sketches = reps.select("doc", "sketch").join(wanted, "doc", "left_semi")
    more = written(_candidates(rows, sketches, sets, least), "dups-pairs")
    links = written(links.unionByName(verify(more, sets, percent)), "dups-links")

    comp = connected_components(links, written, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count("*").alias("n_links"))
    found = classes.join(comp, classes.doc == comp.node, "left").join(degree, classes.doc == degree.d, "left")
    found = found.select("digest", "class_id", F.coalesce("component", "doc").alias("_comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # the smallest doc_id of a component is its label, but for nodes below all ids
    low = found.filter(F.col("_comp") < F.lit(LEAST // 2)).groupBy("_comp").agg(F.min("class_id").alias("_low")).withColumnRenamed("_comp", "_c")
    found = found.join(low, F.col("_comp") == F.col("_c"), "left")
    return base.drop("sketch"), found.select("digest", "class_id", F.coalesce("_low", "_comp").alias("component_id"), "n_links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """A row for every document: doc_id, n_shingles, class_id (the smallest doc_id of an equal set), component_id, kept, n_links.

    ``n_links``: confirmed links of the document's class, a lower bound; only those that the groups needed.
    """
    rows, classes = _members(docs, k, percent)
    out = rows.join(written(classes, "dups-groups"), "digest", "left")
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which each group keeps one, in the columns of ``docs``, which may have any names.

    A group keeps the document of its smallest doc_id; of several texts of this doc_id in the group, and of
    repeated rows, one. Rows with null doc_id are kept, and texts without words once for each doc_id and text.
    """
    d, names = neutral(docs, ("doc_id", "text"))
    rows, classes = _members(d, k, percent)
    rows = rows.filter("doc_id IS NOT NULL").join(written(classes, "dups-groups"), "digest", "left")
    # without words there is no digest to be grouped by: such a row is by itself
    group = F.struct(F.coalesce("component_id", "doc_id").alias("c"), F.when(F.col("component_id").isNull(), F.col("row_hash")).alias("h"))
    keep = rows.groupBy(group.alias("_group")).agg(F.min(F.struct("doc_id", "row_hash")).alias("_k")).select(F.col("_k.doc_id").alias("_d"), F.col("_k.row_hash").alias("_h"))
    mine = d.withColumn("_hash", F.xxhash64("text")).filter("doc_id IS NOT NULL")
    kept = mine.join(written(keep.distinct(), "dups-kept"), (F.col("doc_id") == F.col("_d")) & (F.col("_hash") == F.col("_h")), "left_semi")
    # repeated rows, however many, are reduced before the shuffle; any of them will do if they differ in other columns
    one = kept.groupBy("doc_id", "_hash").agg(F.min_by(F.struct(*d.columns), F.xxhash64(*_hashable(d))).alias("_row")).select("_row.*")
    out = one.unionByName(d.filter("doc_id IS NULL"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def _hashable(df: DataFrame) -> list[str]:
    """Columns that Spark can hash: none with maps or variants in them."""
    return [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
