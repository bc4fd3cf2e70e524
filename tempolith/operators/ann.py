"""Approximate nearest neighbours: an inverted file over trained centroids, product codes, exact re-ranking.

Every vector is filed under its nearest centroid, with the codes of its parts. A query looks into the ``probes`` lists
whose centroids are nearest to it, sums precomputed distances of codes there, and the best of these candidates are
ranked by their own vectors. By cosine, vectors are compared at unit length, where both orders agree.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` vectors, by hashed key); every vector is indexed.
Lists are cut into chunks and queries into blocks, so no task holds more than one of each, and a chunk meets the blocks
of those queries only that look into its list. Null vectors, and those with null or non-finite parts, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, CHUNK, BLOCK = 32_768, 8192, 256


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(~bad, F.lit(False))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :])


def _means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of ``k`` clusters; empty ones take the points that are farthest from theirs."""
    rng = np.random.Generator(np.random.PCG64(5))
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        d = _squares(x, c)
        near = d.argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for at, far in zip(np.flatnonzero(n == 0), np.argsort(-d.min(axis=1), kind="stable")):
            c[at] = x[far]
    return c


@dataclass
class Quantizer:
    metric: str
    centroids: np.ndarray
    books: np.ndarray  # parts x entries x components of a part, of what is left of vectors without their centroids

    def prepared(self, column) -> np.ndarray:
        x = np.array(list(column), dtype=np.float64).reshape(len(column), -1)
        width = self.centroids.shape[1]
        x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]
        if self.metric == "cosine":
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        return x

    def filed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each vector."""
        near = _squares(x, self.centroids).argmin(axis=1)
        rest = x - self.centroids[near]
        size = self.books.shape[2]
        codes = [_squares(rest[:, p * size : (p + 1) * size], b).argmin(axis=1) for p, b in enumerate(self.books)]
        return near, np.stack(codes, axis=1).astype(np.uint8)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(_squares(x, self.centroids), axis=1, kind="stable")[:, :probes]

    def estimates(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the vectors of a list, by their codes."""
        rest = q - self.centroids[at]
        size = self.books.shape[2]
        out = np.zeros((len(q), len(codes)))
        for p, b in enumerate(self.books):
            out += _squares(rest[:, p * size : (p + 1) * size], b)[:, codes[:, p]]
        return out


@dataclass
class VectorIndex:
    rows: DataFrame  # list, key, codes
    vectors: DataFrame  # key, vector
    shared: object
    sizes: dict[int, int]


def fit(vectors: DataFrame, key: str, vector: str, lists: int, parts: int = 8, entries: int = 64, metric: str = "cosine", sample: int = SAMPLE) -> Quantizer:
    """Centroids of ``lists`` and codebooks, from at most ``sample`` vectors."""
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = vectors.filter(_usable(F.col(vector))).orderBy(F.xxhash64(F.col(key)), key).limit(sample).select(vector).collect()
    if not rows:
        raise ValueError("there are no vectors to fit an index on")
    width = -(-max(len(r[0]) for r in rows) // parts) * parts
    q = Quantizer(metric, np.zeros((1, width)), np.zeros((parts, 1, width // parts)))
    x = q.prepared([list(r[0]) + [0.0] * (width - len(r[0])) for r in rows])
    q.centroids = _means(x, min(lists, len(x)))
    rest = x - q.centroids[_squares(x, q.centroids).argmin(axis=1)]
    size = width // parts
    q.books = np.stack([_means(rest[:, p * size : (p + 1) * size], min(entries, len(x))) for p in range(parts)])
    return q


def build(vectors: DataFrame, key: str, vector: str, q: Quantizer, path: str) -> VectorIndex:
    """Write the index of ``vectors`` to ``path``, by lists, so that readers can skip those that nobody looks into."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(q)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = shared.value.prepared(b.column("vector").to_pylist())
            near, codes = shared.value.filed(x)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column("key"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "key", "codes"])

    v = vectors.filter(_usable(F.col(vector))).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    v.mapInArrow(run, "list int, key long, codes binary").sortWithinPartitions("list").write.parquet(path)
    rows = spark.read.schema("list int, key long, codes binary").parquet(path)
    sizes = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    return VectorIndex(rows, v, shared, sizes)


def near(index: VectorIndex, queries: DataFrame, query: str, vector: str, k: int, probes: int, rerank: int = 10) -> DataFrame:
    """(query, key, score, rank): the ``k`` nearest of each query among what ``probes`` lists hold, itself left out.

    ``rerank`` times k candidates of each query are ranked by their vectors. Scores are cosines, or distances by L2.
    """
    shared, most = index.shared, k * rerank
    metric = shared.value.metric
    q = queries.filter(_usable(F.col(vector))).select(F.col(query).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("vector"))

    def probe(batches):
        import pyarrow as pa

        for b in batches:
            x = shared.value.prepared(b.column("vector").to_pylist())
            lists = shared.value.probed(x, probes)
            at = np.repeat(np.arange(len(x)), lists.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(at)), b.column("vector").take(pa.array(at)), pa.array(lists.reshape(-1).astype(np.int32))], names=["query", "vector", "list"])

    asked = q.mapInArrow(probe, "query long, vector array<double>, list int")
    chunks = {at: -(-n // CHUNK) for at, n in index.sizes.items()}
    if not chunks:
        return q.select("query", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    n_chunks = F.element_at(F.create_map(*[F.lit(x) for c in chunks.items() for x in c]), F.col("list"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    filed = index.rows.join(blocks, "list").withColumn("chunk", F.pmod(F.xxhash64("key"), n_chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.join(blocks, "list").filter(n_chunks.isNotNull()).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))

    def look(key, held, some):
        import pandas as pd

        out = pd.DataFrame({"query": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "estimate": np.zeros(0)})
        if not len(held) or not len(some):
            return out
        codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(held), -1)
        d = shared.value.estimates(shared.value.prepared(some["vector"]), key[0], codes)
        d[some["query"].to_numpy()[:, None] == held["key"].to_numpy()[None, :]] = np.inf
        take = min(most, d.shape[1])
        best = np.argpartition(d, take - 1, axis=1)[:, :take]
        est = np.take_along_axis(d, best, axis=1).reshape(-1)
        ok = np.isfinite(est)
        return pd.DataFrame({"query": np.repeat(some["query"].to_numpy(), take)[ok], "key": held["key"].to_numpy()[best.reshape(-1)][ok], "estimate": est[ok]})

    by = ["list", "chunk", "block"]
    found = filed.select(*by, "key", "codes").groupBy(*by).cogroup(asked.select(*by, "query", "vector").groupBy(*by)).applyInPandas(look, "query long, key long, estimate double")
    best = Window.partitionBy("query").orderBy("estimate", "key")
    found = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most).select("query", "key")
    pairs = found.join(q.withColumnRenamed("vector", "a"), "query").join(index.vectors.withColumnRenamed("vector", "b"), "key")
    from ..functions import arrays

    score = arrays.cosine(F.col("a"), F.col("b")) if metric == "cosine" else arrays.l2_distance(F.col("a"), F.col("b"))
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    ranked = pairs.select("query", "key", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "key")))
    return ranked.filter(F.col("rank") <= k)
