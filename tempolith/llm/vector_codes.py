"""Product codes of vectors: integer codebooks for each part of a vector, trained by exact rounds.

Components become integers floor(4096 x), and a vector is cut into equal consecutive parts. A part's codebook starts
as that part of the vectors of smallest id. In a round the codebooks are broadcast, and Arrow batches compute all
squared distances by norm expansion, |x|^2 - 2 x.c + |c|^2, with exact 64-bit matrix products; the first least one
wins. A task adds up its own parts and counts for each entry, a grouped shuffle merges these, and an entry becomes
the floor of its parts' mean. After the last round all parts are assigned once more.

What a task sends is one row an entry, whatever it has read, and the driver holds codebooks only. Nothing but the
last assignment is written, for the sums by label are joined to it.

Defined cases: vectors that are null, or have null, NaN or infinite components, are dropped; vectors shorter than the
longest one, or whose length isn't a multiple of the number of parts, count as filled up with 0; null ids come last
and equal ids in the order of their components, when the first entries are taken; fewer vectors than entries make
smaller codebooks, equal entries leave the later one unused; null labels are one label; rows that are repeated are
coded each; an empty table gives none. Where sums could pass 64 bits (the bound is checked before), ValueError is
raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, written
from .topk import usable

SCALE = 4096.0
#: No vector with such a component is coded: ``train`` raises.
TOO_LARGE = 2.0**31
#: Rows that distances are computed for at once.
SLICE = 8192
#: Labels whose error is broadcast; rows of others meet it by a shuffle.
HOT_LABELS = 10_000


def matrix(column, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(integer components, which rows are kept) of an Arrow list array; rows are at least ``width`` long."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column if isinstance(column, pa.Array) else pa.array(column, pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    absent = flat.is_null().to_numpy(zero_copy_only=False)
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) * SCALE
    bad = absent | ~np.isfinite(x)
    row = np.repeat(np.arange(len(sizes)), sizes)
    kept &= np.bincount(row[bad], minlength=len(sizes)) == 0
    x = np.floor(np.where(bad, 0.0, x))
    x = np.clip(x, -TOO_LARGE, TOO_LARGE)
    width = max(width, int(sizes.max()) if len(sizes) else 0)
    out = np.zeros((len(sizes), width), np.int64)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x.astype(np.int64)
    return out[kept], kept


class Codebooks:
    """``entries`` is parts x entries x components of a part."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.norms = (entries * entries).sum(axis=2)

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part of each row; exact, ties to the lower entry."""
        n, (parts, _, dims) = len(x), self.entries.shape
        codes, errors = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
        for p in range(parts):
            v = x[:, p * dims : (p + 1) * dims]
            d = (v * v).sum(axis=1)[:, None] - 2 * (v @ self.entries[p].T) + self.norms[p][None, :]
            codes[:, p] = np.argmin(d, axis=1)
            errors[:, p] = d[np.arange(n), codes[:, p]]
        return codes, errors

    def digest(self) -> str:
        import hashlib

        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _slices(batches: Iterator, width: int) -> Iterator:
    for b in batches:
        for a in range(0, b.num_rows, SLICE):
            some = b.slice(a, SLICE)
            yield some, *matrix(some.column("embedding"), width)


def _measure(batches):
    import pyarrow as pa

    n = longest = most = 0
    for _, x, _ in _slices(batches, 0):
        if len(x):
            n, longest, most = n + len(x), max(longest, x.shape[1]), max(most, int(np.abs(x).max()) if x.size else 0)
    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (n, longest, most)], names=["n", "longest", "most"])


def _sum_tasks(shared):
    @lean
    def run(batches):
        import pyarrow as pa

        books = shared.value
        parts, entries, dims = books.entries.shape
        sums, counts = np.zeros((parts * entries, dims), np.int64), np.zeros(parts * entries, np.int64)
        for _, x, _ in _slices(batches, books.width):
            at = (books.nearest(x)[0] + np.arange(parts) * entries).reshape(-1)
            v = x.reshape(-1, dims)
            order = np.argsort(at, kind="stable")
            used, first = np.unique(at[order], return_index=True)
            if len(used):
                sums[used] += np.add.reduceat(v[order], first, axis=0)
            counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[used].reshape(-1)), dims).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used]), lists], names=["at", "n", "sums"])

    return run


def _code_tasks(shared):
    @lean
    def run(batches):
        import pyarrow as pa

        books = shared.value
        for b, x, kept in _slices(batches, books.width):
            codes, errors = books.nearest(x)
            digits = codes.astype(np.uint8).tobytes().hex()
            w = 2 * codes.shape[1]
            rows = b.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), pa.array([digits[i * w : (i + 1) * w] for i in range(len(x))], pa.string()), pa.array(errors.sum(axis=1))],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def _first_vectors(vectors: DataFrame, width: int, entries: int) -> np.ndarray:
    """The kept vectors of smallest id, ``entries`` at most."""
    rows = vectors.filter(usable(F.col("embedding"))).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    return matrix([r["embedding"] for r in rows], width)[0]


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of ``vectors`` (vec_id, embedding) after ``rounds``; None if no vector can be used."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n, longest, most = v.select("embedding").mapInArrow(_measure, "n long, longest long, most long").agg(F.sum("n"), F.max("longest"), F.max("most")).first()
    if not n:
        return None
    width = max(1, -(-longest // parts)) * parts
    if 4 * width * (most + 1) ** 2 >= 2**63 or n * (most + 1) >= 2**63:
        raise ValueError("distances of vectors this long, or sums of so many, don't fit 64 bits")
    first = _first_vectors(v, width, entries)
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, width // parts).transpose(1, 0, 2)))
    dims = width // parts
    for _ in range(rounds):
        shared = v.sparkSession.sparkContext.broadcast(books)
        sums = v.select("embedding").mapInArrow(_sum_tasks(shared), "at long, n long, sums array<bigint>")
        merged = sums.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]).collect()  # a row an entry
        new = books.entries.copy()
        for r in merged:
            p, e = divmod(r["at"], new.shape[1])
            new[p, e] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        shared.unpersist()
        books = Codebooks(new)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of the kept rows of ``vectors`` (vec_id, embedding, label)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    label = vectors.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").mapInArrow(_code_tasks(shared), schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error of all rows of a row's label.

    Sums of at most ``HOT_LABELS`` labels are broadcast, those of most rows; a label beyond them has fewer rows than
    one in ``HOT_LABELS``, and meets its rows by a shuffle that no label can skew.
    """
    coded = written(coded, "vector-codes")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    sums = sums.withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    n_labels, n_rows = sums.agg(F.count("*"), F.sum("_n")).first()
    hot = sums if (n_labels <= HOT_LABELS) else sums.filter(F.col("_n") * HOT_LABELS > n_rows)  # fewer than HOT_LABELS rows
    out = coded.join(F.broadcast(hot), same)
    if n_labels > HOT_LABELS:
        beyond = sums.filter(F.col("_n") * HOT_LABELS <= n_rows)
        out = out.unionByName(coded.join(F.broadcast(hot), same, "left_anti").join(beyond, same))
    return out.drop("_label", "_n")


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label of the kept rows of ``vectors``."""
    books = train(vectors, parts, entries, rounds)
    if books is None:
        empty = vectors.filter(F.lit(False)).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select("*", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    return with_label_error(encode(vectors, books)).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
