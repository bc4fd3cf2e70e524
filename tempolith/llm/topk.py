"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers floor(64 x). With M the greatest norm, each gets one more component sqrt(M^2 - |x|^2),
queries get 0, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x: the highest inner products are the nearest points. The
index keys every vector by its nearest pivot and the distance to it. For a query at distance d from a pivot,
a vector in the annulus at distance r from it is at least |d - r| away, so its score is at most
(|q|^2 + M^2 - (d - r)^2) / 2. Annuli are expanded outwards from d, and stop where that bound falls below the
query's k-th best score; a whole pivot is left out if its nearest annulus does.

A query first searches the list of its own nearest pivot. The k-th best score found there is its floor in the
second round, through all other pivots, so that round makes few rows that don't belong to the result.

Pivots, a quarter of the square root of the number of vectors but at most ``PIVOTS``, are k-means centres of a bounded sample
(``SAMPLE`` vectors a pivot, by hashed id), which also gives each query its first bound; every vector is indexed.
Lists of a pivot are cut into chunks of about ``CHUNK`` vectors, queries into blocks by their own nearest pivot,
so no task holds more than a chunk and a block, and blocks meet the chunks of those pivots only that can improve
one of their queries.

Defined cases: vectors that are null, or have null, NaN or infinite components, take no part; shorter vectors
count as filled up with 0; equal vec_ids are separate candidates, but none is one of its own id, and queries of one
id but different vectors have each their own ranks (told apart by 64-bit digests); ties go to the
smaller vec_id; fewer candidates give fewer rows; an empty table gives none. Scores are 64-bit integers; vectors
whose squared norm in 64ths reaches 2 ** 62 could overflow them and raise ValueError.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHUNK, BLOCK, ANNULUS = 4096, 512, 256
#: At least and at most; sampled vectors for each.
FEWEST, PIVOTS, SAMPLE = 16, 1024, 32
#: Below all scores, and with a negative of its own.
LOW = -(2**63) + 1


def quantized(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(~bad, F.lit(False))


def _matrix(column, dims: int) -> np.ndarray:
    rows = list(column)
    if all(len(r) == dims for r in rows):
        return np.array(rows, dtype=np.int64).reshape(len(rows), dims)
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while they hold them."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Pivots:
    """Pivots in the extended space, and the sample that gives queries their first bound."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m2: int, k: int, pivots: int) -> None:
        self.m2, self.k, self.dims = float(m2), k, x.shape[1]
        self.ids, self.sample = ids, x
        e = self.extend(x)
        rng = np.random.Generator(np.random.PCG64(3))
        c = e[rng.permutation(len(e))[:pivots]]
        for _ in range(6):
            near = np.argmin(self._squares(e, c), axis=1)
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, e)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        self.centres = c

    def extend(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(0, self.m2 - (x * x).sum(axis=1)))[:, None]], axis=1)

    @staticmethod
    def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))

    def distances(self, e: np.ndarray) -> np.ndarray:
        return np.sqrt(self._squares(e, self.centres))

    def first_bound(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The k-th best score of each query in the sample: a floor under its k-th best of all."""
        s = _inner(q, self.sample)
        s = np.where(ids[:, None] == self.ids[None, :], LOW, s)
        if s.shape[1] < self.k:
            return np.full(len(q), LOW)
        return np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]


def best_possible(norm2: np.ndarray, m2: float, gap: np.ndarray) -> np.ndarray:
    """The greatest score at a distance of ``gap`` or more, rounded up past all errors of doubles."""
    return (norm2 + m2 - gap * gap) / 2 + 1e-6 * (norm2 + m2) + 1


def _index_tasks(shared):
    def run(batches):
        import pyarrow as pa

        p = shared.value
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), p.dims)
            d = p.distances(p.extend(x)) if len(x) else np.zeros((0, len(p.centres)))
            near = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), b.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())],
                names=["pivot", "dist", "vec_id", "v"],
            )

    return run


def _pack_index(pdf):
    """A chunk as one row, in the order of distance to the pivot."""
    import pandas as pd

    pdf = pdf.sort_values(["dist", "vec_id"])
    return pd.DataFrame({"pivot": [pdf["pivot"].iloc[0]], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "dists": [pdf["dist"].to_numpy("<f8").tobytes()], "vectors": [b"".join(pdf["v"])]})


def _pack_queries(shared, rings: dict[int, tuple[float, float]], home: bool):
    """A block of queries for each pivot that can improve one of them: their nearest one only, or all but that."""

    def run(pdf):
        import pandas as pd

        p = shared.value
        q = np.frombuffer(b"".join(pdf["v"]), "<i8").reshape(-1, p.dims)
        ids, keys = pdf["vec_id"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64)
        floor = np.maximum(p.first_bound(ids, q), LOW if home else pdf["floor"].to_numpy(np.int64))
        e = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
        d, norm2 = p.distances(e), (e * e).sum(axis=1)
        known = np.array(sorted(rings))
        nearest = known[np.argmin(d[:, known], axis=1)]
        lo, hi = (np.array([rings[x][side] for x in known.tolist()]) for side in (0, 1))
        gap = np.maximum(0, np.maximum(lo - d[:, known], d[:, known] - hi))
        meets = (best_possible(norm2[:, None], p.m2, gap) >= floor[:, None]) & ((nearest[:, None] == known[None, :]) == home)
        out = []
        for at in np.flatnonzero(meets.any(axis=0)):
            pivot, some = int(known[at]), np.flatnonzero(meets[:, at])
            if len(some):
                out.append({"pivot": pivot, "q_ids": ids[some].tobytes(), "q_keys": keys[some].tobytes(), "q_vectors": q[some].tobytes(), "q_floor": floor[some].tobytes(), "q_dists": d[some, pivot].tobytes()})
        return pd.DataFrame(out, columns=["pivot", "q_ids", "q_keys", "q_vectors", "q_floor", "q_dists"])

    return run


def search_chunk(p: Pivots, ids, dists, vectors, q_ids, q, q_floor, q_dists):
    """(place of the query, candidate, score) of a block in a chunk: k of each query at most, none below its floor."""
    norm2 = (q.astype(np.float64) ** 2).sum(axis=1)
    starts = np.arange(0, len(ids), ANNULUS)
    ends = np.minimum(starts + ANNULUS, len(ids))
    lo, hi = dists[starts], dists[ends - 1]
    floor = q_floor.copy()
    # annuli of the chunk by how far they are from the block's queries, nearest first
    gaps = np.maximum(0, np.maximum(lo[None, :] - q_dists[:, None], q_dists[:, None] - hi[None, :]))
    bound = best_possible(norm2[:, None], p.m2, gaps)
    found_s = np.full((len(q), 0), 0, np.int64)
    found_i = np.full((len(q), 0), 0, np.int64)
    for a in np.argsort(gaps.min(axis=0), kind="stable"):
        live = np.flatnonzero(bound[:, a] >= floor)
        if not len(live):
            continue
        part = slice(starts[a], ends[a])
        s = np.full((len(q), ends[a] - starts[a]), LOW)
        s[live] = _inner(q[live], vectors[part])
        s[(q_ids[:, None] == ids[part][None, :]) | (s < floor[:, None])] = LOW
        if not (s > LOW).any():
            continue
        found_s = np.concatenate([found_s, s], axis=1)
        found_i = np.concatenate([found_i, np.broadcast_to(ids[part], s.shape)], axis=1)
        if found_s.shape[1] > p.k:
            order = np.lexsort((found_i, -found_s), axis=1)[:, : p.k]
            found_s, found_i = np.take_along_axis(found_s, order, 1), np.take_along_axis(found_i, order, 1)
            floor = np.maximum(floor, found_s[:, p.k - 1])
    row, col = np.nonzero(found_s > LOW)
    return row, found_i[row, col], found_s[row, col]


def _search_tasks(shared):
    def run(batches):
        import pyarrow as pa

        p = shared.value
        for b in batches:
            for r in b.to_pylist():
                n, m = len(r["ids"]) // 8, len(r["q_ids"]) // 8
                q, i, s = search_chunk(
                    p, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["dists"], "<f8"), np.frombuffer(r["vectors"], "<i8").reshape(n, p.dims),
                    np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_vectors"], "<i8").reshape(m, p.dims), np.frombuffer(r["q_floor"], "<i8"), np.frombuffer(r["q_dists"], "<f8"),
                )
                of = lambda name: pa.array(np.frombuffer(r[name], "<i8")[q], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([of("q_ids"), of("q_keys"), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "query_key", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, sample: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of ``vectors`` (vec_id, embedding) that ``is_query`` holds for."""
    spark = vectors.sparkSession
    v = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    m2, dims, n = v.agg(F.max(norm2), F.max(F.size("v")), F.count("*")).first()
    if m2 is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if m2 >= 2.0**62:
        raise ValueError("scores of vectors this long don't fit 64 bits")
    pivots = min(PIVOTS, max(FEWEST, int(n**0.5 / 4)))
    rows = v.orderBy(F.xxhash64(F.lit(13), "vec_id"), "vec_id").limit(sample or SAMPLE * pivots).select("vec_id", "v").collect()  # bounded by SAMPLE * PIVOTS
    x = _matrix([r["v"] for r in rows], dims)
    shared = spark.sparkContext.broadcast(Pivots(np.array([r["vec_id"] for r in rows], np.int64), x, m2, k, pivots))

    index = written(v.select("vec_id", "v").mapInArrow(_index_tasks(shared), "pivot int, dist double, vec_id long, v binary"), "topk-index")
    rings = index.groupBy("pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).collect()  # a row a pivot
    chunks = F.element_at(F.create_map(*[x for r in rings for x in (F.lit(r["pivot"]), F.lit(-(-r["n"] // CHUNK)))]), F.col("pivot"))
    packed = index.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks)).groupBy("pivot", "chunk").applyInPandas(_pack_index, "pivot int, ids binary, dists binary, vectors binary")
    packed = written(packed, "topk-chunks")

    queries = index.join(v.filter("is_query").select(F.col("vec_id").alias("_q")).distinct(), F.col("vec_id") == F.col("_q"), "left_semi").dropDuplicates(["vec_id", "v"]).withColumn("key", F.xxhash64("v"))
    blocks = F.element_at(F.create_map(*[x for r in rings for x in (F.lit(r["pivot"]), F.lit(-(-r["n"] // (BLOCK * 20)) or 1))]), F.col("pivot"))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), blocks))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")

    def searched(q: DataFrame, home: bool) -> DataFrame:
        pack = _pack_queries(shared, {r["pivot"]: (r["lo"], r["hi"]) for r in rings}, home)
        q = q.groupBy("pivot", "chunk").applyInPandas(pack, "pivot int, q_ids binary, q_keys binary, q_vectors binary, q_floor binary, q_dists binary")
        return packed.join(q, "pivot").mapInArrow(_search_tasks(shared), "query_id long, query_key long, vec_id long, score long")

    near = searched(queries, True).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    near = written(near, "topk-near")
    floors = near.filter(F.col("_r") == k).select(F.col("query_id").alias("_f"), F.col("query_key").alias("_k"), F.col("score").alias("floor"))
    rest = queries.join(floors, (F.col("vec_id") == F.col("_f")) & (F.col("key") == F.col("_k")), "left").withColumn("floor", F.coalesce("floor", F.lit(LOW)))
    found = near.drop("_r").unionByName(written(searched(rest, False), "topk-found"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
