"""Passages of test sets in documents, by Wu-Manber multi-pattern search over words.

A test item is cut into windows of ten consecutive words; an item of fewer words, but not none, is one window.
Distinct windows are the patterns. Those of ten words share tables, shorter ones have tables of their own length m. For
the words of each pattern, the shift table holds, by the hash of a block of two words, how far from a pattern's end the
block lies at least; a block that no pattern has shifts by m - 1. A search looks at the block that ends at its
position: if its shift isn't 0, it skips that many words, as no pattern can end in between. At a shift of 0 the block's
hash selects a bucket of patterns that end in it, the window's digest those of the bucket that may be equal, and direct
comparison of all bytes confirms the occurrence. Many searches advance together: the words of a batch of documents are
cut into stretches, each with a position of its own, and numpy moves all positions that are left at once.

The patterns are broadcast in blocks of at most ``BLOCK`` characters of items (a longer item is a block of its own), so
test sets of any size can be searched for: a task reads each batch of documents once, and holds one block at a time
if there is more than one. Documents aren't shuffled, and nothing but its result leaves a task.

Defined cases: null text has no words, nor have empty ones, and items without words match nothing; a null item id reads
as ''; repeated items or ids count once, windows that several items have count for each; repeated documents, and those
without an id, have a row each; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean
from .shingles import _power, mix

U64 = np.uint64
#: Words of a window.
WINDOW = 10
#: Characters of items whose windows are broadcast together.
BLOCK = 2_000_000
#: Words of a stretch that one position passes over.
STRETCH = 256
#: Bytes of text that are searched at once.
AT_ONCE = 2_000_000
_rng = np.random.Generator(np.random.PCG64(1999))
#: Bytes of words: letters, digits and all that isn't ASCII; in small letters, others as spaces.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LEFT, _RIGHT = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


class Words:
    """The words of an Arrow array of texts: digests, where they lie in ``bytes``, and how many each text has."""

    def __init__(self, texts) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        self.bytes = _LOWER[raw]
        word = np.concatenate([[False], self.bytes != 32, [False]])
        begins, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        inner = at[(at > 0) & (at < len(raw))]  # a text's first byte begins a word, and its last one ends one
        begins[inner] = word[1:-1][inner]
        ends[inner - 1] = word[1:-1][inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _power(len(raw) + 1)
        values = np.where(word[1:-1], _BYTE[self.bytes], U64(0)) * power[: len(raw)]
        self.digest = mix(np.add.reduceat(values, self.start) * inverse[self.start]) if len(self.start) else np.zeros(0, U64)
        self.first = np.searchsorted(self.start, at)  # of each text, and of one after the last
        self.count = np.diff(self.first)

    def windows(self, ends: np.ndarray, m: int) -> np.ndarray:
        """Digests of the ``m`` words up to each of ``ends``."""
        h = np.zeros(len(ends), U64)
        for j in range(m):
            h = mix(h * _LEFT + self.digest[ends - (m - 1 - j)], j)
        return h

    def blocks(self, ends: np.ndarray, m: int) -> np.ndarray:
        """Digests of the last two words up to each of ``ends``, or of the one that patterns of one word have."""
        last = self.digest[ends] * _RIGHT
        return mix(last if m == 1 else last + self.digest[ends - 1] * _LEFT, 99)


class Patterns:
    """Shift table and buckets of distinct windows of ``m`` words, which end at words ``ends`` of items."""

    def __init__(self, words: Words, ends: np.ndarray, sets: np.ndarray, m: int) -> None:
        self.m, self.sets = m, sets
        self.bits = min(26, max(12, int(4 * len(ends) * max(1, m - 1)).bit_length()))
        self.shift = np.full(1 << self.bits, max(1, m - 1), np.uint8)
        for back in range(max(1, m - 1) - 1, -1, -1):  # the least distance from the end is written last
            self.shift[self._slot(words.blocks(ends - back, m))] = back
        digest = words.windows(ends, m)
        key = self._key(words.blocks(ends, m), digest)
        order = np.argsort(key, kind="stable")
        self.key, self.sets = key[order], sets[order]
        self.text, self.length = _gathered(words, ends[order], m)
        self.at = np.cumsum(self.length) - self.length

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> U64(64 - self.bits)).astype(np.int64)

    def _key(self, block: np.ndarray, window: np.ndarray) -> np.ndarray:
        """A bucket, by the last block's hash, and a place in it, by the window's digest."""
        return ((block >> U64(64 - self.bits)) << U64(64 - self.bits)) | (window >> U64(self.bits))

    def ends_in(self, words: Words) -> np.ndarray:
        """Words of the texts at which a shift of 0 stops a search."""
        m = self.m
        first, last = words.first[:-1] + m - 1, words.first[1:]
        n = np.maximum(0, -(-(last - first) // STRETCH))
        base = np.repeat(first, n)
        place = (np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        at, stop = base + place, np.minimum(base + place + STRETCH, np.repeat(last, n))
        found = []
        while len(at):
            shift = self.shift[self._slot(words.blocks(at, m))]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word of each occurrence, set of the items that have it)."""
        ends = self.ends_in(words)
        key = self._key(words.blocks(ends, self.m), words.windows(ends, self.m))
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.repeat(ends, n)
        same = np.zeros(len(ends), bool)
        for a in range(0, len(ends), 100_000):  # a comparison holds all bytes of both sides
            part = slice(a, a + 100_000)
            text, length = _gathered(words, ends[part], self.m)
            fits = length == self.length[which[part]]
            keep = np.repeat(fits, length)
            size = length[fits]
            begin = np.cumsum(size) - size
            mine = np.repeat(self.at[which[part]][fits] - begin, size) + np.arange(size.sum())
            equal = text[keep] == self.text[mine]
            ok = np.zeros(len(fits), bool)
            ok[fits] = np.logical_and.reduceat(equal, begin) if len(size) else False
            same[part] = ok
        return ends[same], self.sets[which[same]]


def _gathered(words: Words, ends: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the windows of ``m`` words up to ``ends``, a space after each word, and the bytes of each window."""
    some = (ends[:, None] - np.arange(m - 1, -1, -1)[None, :]).reshape(-1)
    start, size = words.start[some], words.end[some] - words.start[some] + 1
    total = np.cumsum(size)
    at = np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)
    out = words.bytes[np.minimum(at, max(0, len(words.bytes) - 1))]
    out[total - 1] = 32
    return out, size.reshape(-1, m).sum(axis=1) if len(ends) else np.zeros(0, np.int64)


class Index:
    """The windows of some items, in tables by their number of words."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        import pyarrow as pa

        names = sorted(set(ids))
        number = {x: i for i, x in enumerate(names)}
        words = Words(pa.array(texts, pa.large_string()))
        item = np.array([number[x] for x in ids], np.int64)
        self.names: list[str] = names
        #: Items of each set: all windows that the same items have share one.
        self.items: list[tuple[int, ...]] = []
        self.tables: list[Patterns] = []
        known: dict[tuple[int, ...], int] = {}
        m_of = np.minimum(words.count, window)
        for m in np.unique(m_of[m_of > 0]).tolist():
            rows = np.flatnonzero(m_of == m)
            n = words.count[rows] - m + 1
            ends = np.repeat(words.first[rows] + m - 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(item[rows], n)
            text, length = _gathered(words, ends, m)
            at = np.concatenate([[0], np.cumsum(length)]).tolist()
            raw = text.tobytes()
            have: dict[bytes, tuple[int, set[int]]] = {}
            for e, o, a, b in zip(ends.tolist(), owner.tolist(), at[:-1], at[1:]):
                have.setdefault(raw[a:b], (e, set()))[1].add(o)
            sets = [known.setdefault(tuple(sorted(s)), len(known)) for _, s in have.values()]
            self.tables.append(Patterns(words, np.array([e for e, _ in have.values()], np.int64), np.array(sets, np.int64), m))
        self.items = list(known)

    def search(self, words: Words) -> tuple[list[np.ndarray], np.ndarray]:
        """(first word, word after the last) of all occurrences, and the distinct (text, set of items)."""
        stretches, sets = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for t in self.tables:
            last, of = t.search(words)
            stretches.append(np.stack([last - t.m + 1, last + 1], axis=1))
            text = np.searchsorted(words.first, last, side="right") - 1
            sets.append(np.stack([text, of], axis=1))
        return stretches, np.unique(np.concatenate(sets), axis=0)


def _spans(stretches: np.ndarray, n: int) -> np.ndarray:
    """Stretches of words, merged where they meet or touch."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, stretches[:, 0], 1)
    np.add.at(depth, stretches[:, 1], -1)
    hit = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
    return np.stack([np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])], axis=1)


def _search_tasks(shared: list):
    @lean
    def run(batches):
        import pyarrow as pa

        held = shared[0].value if len(shared) == 1 else None
        for batch in batches:
            for b in chunks(batch, AT_ONCE):
                words = Words(b.column("text"))
                hits, items = [], [set() for _ in range(b.num_rows)]
                for one in shared:
                    index = held or one.value
                    stretches, pairs = index.search(words)
                    hits += stretches
                    for i, s in pairs.tolist():
                        items[i].update(index.names[k] for k in index.items[s])
                    if not held:
                        one.__dict__.pop("_value", None)  # the next block takes its place
                        del index
                # a text's last word and the next one's first aren't one stretch
                spans = [np.zeros((0, 2), np.int64)] * b.num_rows
                hit = np.concatenate(hits)
                text = np.searchsorted(words.first, hit[:, 0], side="right") - 1
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(b.num_rows + 1))
                for i in np.unique(text).tolist():
                    spans[i] = _spans(hit[order[cuts[i] : cuts[i + 1]]] - words.first[i], int(words.count[i]))
                lists = [[{"begin": x, "end": y} for x, y in s.tolist()] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(lists, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "spans", "items"],
                )

    return run


def indexes(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> list:
    """The windows of ``benchmark`` (item_id, text), broadcast in blocks; the driver holds one at a time."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text IS NOT NULL")
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * total // block) if total > block else 1
    out = []
    for k in range(n):
        rows = (b.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else b).collect()  # about half a block of characters
        index = Index([r["item_id"] for r in rows], [r["text"] for r in rows], window)
        if index.tables:
            out.append(b.sparkSession.sparkContext.broadcast(index))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans, items of every row of ``docs`` (doc_id, text).

    ``spans`` are the stretches of words (from 0, the end not included) inside occurrences of windows of ``benchmark``,
    ``items`` the ids, as strings in order, of the items that these windows are of.
    """
    shared = indexes(benchmark, window, block)
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "text")
    if not shared:
        shared = [d.sparkSession.sparkContext.broadcast(Index([], [], window))]
    return d.mapInArrow(_search_tasks(shared), f"doc_id {kind}, n_words long, spans array<struct<begin: long, end: long>>, items array<string>")
