"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut further where a word's first character says so (one word in four or five),
and after LONGEST code points, so that a change to a long line leaves most of its parts alone. Each has a 64-bit digest; the k-th equal paragraph of a text has another one than the first,
so a text is a set. A sketch has three stripes of cells (count, xor of digests, xor of their checks), and a
digest goes to one cell of each stripe. Subtracting the sketch of another version leaves the digests that
differ; cells with one left are peeled until all have gone. A sketch too small for the difference fails to
empty, and both are made again with twice the cells.

The fingerprint of a text is its sketch of ``CELLS`` cells, in base64, after the number of its paragraphs; two
texts of up to about ``CELLS / 1.5`` differing paragraphs are compared from their fingerprints alone, by
subtraction. Where that doesn't peel, both texts are sketched again, larger. The likeness of two texts is the Jaccard index of their paragraph sets: 1 if they are equal.

Neighbours in descending doc_id are found by ranges of doc_id, a partition each; the first document of a range
is also sent to the range before it, so nothing but one document a partition travels twice.

Defined cases: null text is empty; an empty text has no paragraphs, and two such texts are alike by 1; null
doc_ids come last; equal doc_ids go by text; a single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST, lean, partitions, range_bounds, range_of

#: Cells of the fingerprint; larger sketches double it.
CELLS = 12
U64 = np.uint64


#: Paragraphs end at line ends, and at spaces before a character of these: every eighth code point of the plane.
_CUT = re.compile("\n+| +(?=[" + "".join(re.escape(chr(c)) for c in range(0x24, 0xD800, 8)) + "])")
#: Code points of a paragraph at most; longer ones are cut from their start.
LONGEST = 96


def paragraphs(text: str) -> list[str]:
    out = [p for p in _CUT.split(text) if p]
    if out and len(max(out, key=len)) > LONGEST:
        out = [p[i : i + LONGEST] for p in out for i in range(0, len(p), LONGEST)]
    return out


def digests(text: str) -> list[int]:
    import xxhash

    ps = [p.encode("utf-8", "surrogatepass") for p in paragraphs(text)]
    out = list(map(xxhash.xxh64_intdigest, ps))
    if len(set(out)) < len(out):
        seen: dict[int, int] = {}
        for i, d in enumerate(out):
            k = seen[d] = seen.get(d, -1) + 1
            if k:
                out[i] = xxhash.xxh64_intdigest(ps[i], seed=k)
    return out


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ U64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def _cells(d: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of each digest, one a stripe; they change with the size of the sketch."""
    third = cells // 3
    return np.stack([(_mix(d, 3 * cells + j) % U64(third)).astype(np.int64) + j * third for j in range(3)])


class Sketches:
    """Sketches of many texts side by side: row i of each array is text i's."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, dtype=np.int32)
        self.key = np.zeros(n * cells, dtype=U64)
        self.check = np.zeros(n * cells, dtype=U64)

    def add(self, which: np.ndarray, d: np.ndarray, sign) -> None:
        at = (_cells(d, self.cells) + which * self.cells).ravel()
        np.add.at(self.count, at, np.tile(np.broadcast_to(np.asarray(sign, np.int32), d.shape), 3))
        np.bitwise_xor.at(self.key, at, np.tile(d, 3))
        np.bitwise_xor.at(self.check, at, np.tile(_mix(d, 1) >> U64(32), 3))

    def rows(self, which: np.ndarray) -> Sketches:
        """The sketches of some texts, as copies."""
        out = Sketches.__new__(Sketches)
        out.n, out.cells = len(which), self.cells
        for name in ("count", "key", "check"):
            setattr(out, name, getattr(self, name).reshape(self.n, self.cells)[which].ravel())
        return out

    def minus(self, other: Sketches, which: np.ndarray) -> Sketches:
        """The differences of some rows."""
        a, b = self.rows(which), other.rows(which)
        a.count -= b.count
        a.key ^= b.key
        a.check ^= b.check
        return a

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, digest, sign) of what could be recovered; a text's cells are all empty if that's everything."""
        found = []
        while True:
            at = np.flatnonzero((self.count == 1) | (self.count == -1))
            at = at[(_mix(self.key[at], 1) >> U64(32)) == self.check[at]]
            if not len(at):
                break
            which, d, sign = at // self.cells, self.key[at], self.count[at]
            # a digest may be alone in several of its cells
            order = np.lexsort((d, which))
            which, d, sign = which[order], d[order], sign[order]
            new = np.ones(len(d), dtype=bool)
            new[1:] = (which[1:] != which[:-1]) | (d[1:] != d[:-1])
            which, d, sign = which[new], d[new], sign[new]
            found.append((which, d, sign))
            self.add(which, d, -sign)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found))

    def empty(self) -> np.ndarray:
        z = (self.count == 0) & (self.key == 0) & (self.check == 0)
        return z.reshape(self.n, self.cells).all(axis=1)


def _flat(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    d = np.fromiter((x for s in sets for x in s), U64, int(sizes.sum()))
    return np.repeat(np.arange(len(sets)), sizes), d


def sketched(sets: list[list[int]]) -> Sketches:
    """The sketches that fingerprints are made of."""
    s = Sketches(len(sets), CELLS)
    which, d = _flat(sets)
    if len(d):
        s.add(which, d, 1)
    return s


def encode(sets: list[list[int]], s: Sketches | None = None) -> list[str]:
    """Fingerprints of texts, from their digests."""
    s = s or sketched(sets)
    rows = np.concatenate([s.count.astype("<i4").view("u1").reshape(-1, CELLS * 4), s.key.astype("<u8").view("u1").reshape(-1, CELLS * 8), s.check.astype("<u4").view("u1").reshape(-1, CELLS * 4)], axis=1)
    return [f"{len(x)}:{base64.b64encode(r.tobytes()).decode()}" for x, r in zip(sets, rows)]


def differences(a: list[list[int]], b: list[list[int]], made: tuple[Sketches, Sketches] | None = None) -> list[tuple[list[int], list[int]]]:
    """For each pair, the digests only in its first and only in its second text, by peeling ever larger sketches.

    The first try subtracts the fingerprints' sketches (``made``, if they are there already).
    """
    out: list = [([], []) for _ in a]
    todo, cells = list(range(len(a))), CELLS
    while todo:
        # a difference in number that a sketch can't hold needs no try
        now = [i for i in todo if abs(len(a[i]) - len(b[i])) <= cells]
        if now:
            if cells == CELLS and made:
                s = made[0].minus(made[1], np.array(now))
            else:
                s = Sketches(len(now), cells)
                for sets, sign in ((a, 1), (b, -1)):
                    which, d = _flat([sets[i] for i in now])
                    if len(d):
                        s.add(which, d, sign)
            which, d, sign = s.peel()
            good = s.empty()
            for w, x, g in zip(which[good[which]].tolist(), d[good[which]].tolist(), sign[good[which]].tolist()):
                out[now[w]][g < 0].append(x)
            done = {i for i, ok in zip(now, good.tolist()) if ok}
            todo = [i for i in todo if i not in done]
        if todo and cells > 64 * (CELLS + max(len(a[i]) + len(b[i]) for i in todo)):
            raise RuntimeError("sketches that are far larger than their texts can't be peeled: digests collide")
        cells *= 2
    return out


def likeness(a: list[list[int]], b: list[list[int]], made: tuple[Sketches, Sketches] | None = None) -> list[float]:
    out = []
    for (only_a, only_b), x in zip(differences(a, b, made), a):
        both = len(x) - len(only_a)
        union = both + len(only_a) + len(only_b)
        out.append(both / union if union else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the start of the next document."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Code points of the texts that are worked on at once.
AT_ONCE = 2_000_000


def _run(batches):
    import pyarrow as pa

    def make(pairs):
        texts = [t for _, t, _ in pairs]
        own = [digests(t) for t in texts]
        new = [edited(t, f) for _, t, f in pairs]
        changed = [own[i] if new[i] == texts[i] else digests(new[i]) for i in range(len(pairs))]
        after = [*own[1:], digests(pairs[-1][2])]
        every = sketched([*own, after[-1]])
        of_own, of_after, of_new = every.rows(np.arange(len(own))), every.rows(np.arange(1, len(own) + 1)), sketched(changed)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array(list(map(len, texts)), pa.int64()),
             pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new]), pa.array(encode(own, of_own)), pa.array(encode(changed, of_new)),
             pa.array(likeness(own, changed, (of_own, of_new)), pa.float64()), pa.array(likeness(own, after, (of_own, of_after)), pa.float64())],
            names=[f.split()[0] for f in SCHEMA.split(", ")],
        )

    pairs, size, last = [], 0, None
    for b in batches:
        for doc, text, ghost in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("ghost").to_pylist()):
            text = text or ""
            if last is not None:
                pairs.append((*last, text))
                size += len(text)
                if size > AT_ONCE or ghost:
                    yield make(pairs)
                    pairs, size = [], 0
            last = None if ghost else (doc, text)
            if ghost:
                return  # the first ghost is the neighbour; equal ids may have sent more


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ghost) in partitions by range, descending; after a partition's documents, as ghost, the next one."""
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", partitions(spark))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_range", range_of(F.col("doc_id"), bounds))
    # the first document of each range, going down: a row a partition
    heads = {r["_range"]: r["head"] for r in d.groupBy("_range").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    to = {r: order[i - 1] for i, r in enumerate(order)}  # the range before it; the last one goes to the first, round the end
    head = np.array([heads.get(i) if heads.get(i) is not None else LEAST for i in range(len(bounds) + 1)], dtype=np.int64)
    target = np.array([to.get(i, -1) for i in range(len(bounds) + 1)], dtype=np.int32)

    @F.pandas_udf("int")
    def sent_to(doc, where):
        import pandas as pd

        w = where.to_numpy()
        return pd.Series(np.where(doc.to_numpy() == head[w], target[w], -1).astype("int32"))

    # without nulls pandas keeps longs exact
    ghost = sent_to(F.coalesce("doc_id", F.lit(LEAST)), "_range")
    ghost = F.when(ghost >= 0, ghost)
    d = d.withColumn("_ghost", ghost)
    places = F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("_ghost").alias("at"), F.lit(True).alias("ghost")))
    d = d.withColumn("_place", F.explode(F.filter(places, lambda p: p.at.isNotNull()))).select("doc_id", "text", "_place.at", "_place.ghost")
    return d.repartitionById(len(bounds) + 1, "at").sortWithinPartitions("ghost", F.col("doc_id").desc_nulls_last(), "text").drop("at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for every document: its fingerprint, that of its edited text, and how alike they and the next one are."""
    return with_next(docs).mapInArrow(lean(_run), SCHEMA)
