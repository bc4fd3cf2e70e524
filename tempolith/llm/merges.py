"""Byte-pair merges of many short words at once, in numpy: the ids that the library gives, for plain words.

Words of one length are the rows of a matrix. In each round every row merges its pair of the lowest rank, the
leftmost of these, so all rows that still change lose one symbol and the matrix stays a rectangle; rows without
a known pair are done. Ranks of pairs come from a hash table with linear probing.
"""

from __future__ import annotations

import numpy as np

_BITS = 18
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """How byte-level vocabularies spell each byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Merges:
    """Pairs of ids, the rank of each pair, and what it becomes."""

    def __init__(self, spec: dict) -> None:
        """``spec``: the model of a byte-level vocabulary file. ValueError if it has rules other than merges."""
        if spec.get("type") != "BPE" or spec.get("dropout") or spec.get("ignore_merges") or spec.get("byte_fallback") or spec.get("continuing_subword_prefix"):
            raise ValueError("not plain merges")
        vocab, end = spec["vocab"], spec.get("end_of_word_suffix") or ""
        try:
            self.first = np.array([vocab[c] for c in byte_symbols()], np.int32)
            self.last = np.array([vocab[c + end] for c in byte_symbols()], np.int32)
            pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
            ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        except KeyError as e:
            raise ValueError("bytes or merges without ids") from e
        self.step = int(max(vocab.values())) + 1
        self.made = ids[:, 2].astype(np.int32)
        keys = ids[:, 0] * self.step + ids[:, 1]
        if len(keys) > 1 << (_BITS - 1):
            raise ValueError("too many merges for the table")
        self.keys = np.full(1 << _BITS, -1, np.int64)
        self.ranks = np.full(1 << _BITS, _NONE, np.int32)
        at, left = self._hash(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)  # one pair a place; the others try the next
            put = free[one]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], put
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & ((1 << _BITS) - 1)

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _TIMES) >> np.uint64(64 - _BITS)).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.step + b
        at = self._hash(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], _NONE)
        todo = np.nonzero((there != keys) & (there >= 0))
        while len(todo[0]):
            at[todo] = (at[todo] + 1) & ((1 << _BITS) - 1)
            there, k = self.keys[at[todo]], keys[todo]
            out[todo] = np.where(there == k, self.ranks[at[todo]], _NONE)
            more = (there != k) & (there >= 0)
            todo = tuple(x[more] for x in todo)
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words are ranges of bytes, none empty. (How many ids each has; ids of all, one after another)."""
        counts = np.zeros(len(sizes), np.int64)
        blocks = []
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            rows = order[a:b]
            n = int(sizes[rows[0]])
            raw = data[starts[rows][:, None] + np.arange(n)]
            s = self.first[raw]
            s[:, -1] = self.last[raw[:, -1]]
            r = self.rank(s[:, :-1], s[:, 1:])
            while True:
                if n > 1:
                    j = r.argmin(axis=1)
                    best = r[np.arange(len(r)), j]
                    live = best < _NONE
                else:
                    live = np.zeros(len(s), bool)
                if not live.all():
                    done = ~live
                    blocks.append((rows[done], s[done]))
                    counts[rows[done]] = n
                    if not live.any():
                        break
                    rows, s, r, j, best = rows[live], s[live], r[live], j[live], best[live]
                every = np.arange(len(s))
                s[every, j] = self.made[best]
                n -= 1
                columns = np.arange(n)
                s = np.where(columns <= j[:, None], s[:, :n], s[:, 1:])
                r = np.where(columns[:-1] < j[:, None], r[:, : n - 1], r[:, 1:])
                x = np.flatnonzero(j < n - 1)
                r[x, j[x]] = self.rank(s[x, j[x]], s[x, j[x] + 1])
                x = np.flatnonzero(j > 0)
                r[x, j[x] - 1] = self.rank(s[x, j[x] - 1], s[x, j[x]])
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for rows, s in blocks:
            out[(ends[rows] - counts[rows])[:, None] + np.arange(s.shape[1])] = s
        return counts, out
