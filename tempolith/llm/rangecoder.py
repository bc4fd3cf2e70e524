"""Adaptive context-mixing range coder for token ids, run on many independent blocks at once.

A block is BLOCK ids (the last of a group may be shorter). Each block starts from the same state, so any one
can be decoded by itself; numpy runs all blocks of a group side by side, one id of each at a time.

Three predictors look at an id: order 2 (the id that last followed the two ids before it), order 1 (the same
for one id) and order 0 (how often ids occur in the group, from the group's header). The first two learn
within the block, in hashed tables with a confidence of 0 to 3. Their confidences, and whether they agree,
select a context whose two adaptive probabilities say how much weight order 2 and order 1 get; the rest is
order 0's. The interval of [0, 1) that the mix gives the id narrows a 64-bit range coder, 32 bits at a time.
All arithmetic is in integers, so encoder and decoder agree on every machine.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
#: log2 of table entries a block, for orders 1 and 2.
T1, T2 = 10, 11
#: Bits of the mixing weights; what orders 2 and 1 get at most.
WBITS = 16
MOST = np.int32((1 << WBITS) - 2048)
#: What a right prediction adds to its weight.
GAIN = np.int32(62000 >> 5)
U64, I64, I32 = np.uint64, np.int64, np.int32
_W = U64(WBITS)
_LOW = U64(1 << 32)
_S32 = U64(32)
_ALL = U64(1 << WBITS)


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(ids, frequencies, bits, ranks of the ids): frequencies add up to 2 ** bits, each is at least 1."""
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        place = np.zeros(len(counts), dtype=I32)
        place[values] = np.arange(len(values), dtype=I32)
        counts, rank = counts[values], place.take(ids)
    else:
        values, rank, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = max(17, int(len(values)).bit_length() + 1)
    total = 1 << bits
    freq = np.maximum(1, counts * (total - len(values)) // max(1, int(counts.sum())))
    freq[int(np.argmax(freq))] += total - int(freq.sum())
    return values.astype(np.uint32), freq.astype(np.uint32), bits, rank.astype(I32)


class _Model:
    """State of the blocks of a group, and the tables of its order 0. Ranks count from 1; 0 is "no prediction".

    Table entries are rank << 2 | confidence. Weights decay by 1/32 an id and never below 31, so that every
    prediction keeps an interval; contexts without a prediction have weight 0, and nothing ever adds to it.
    """

    def __init__(self, lanes: int, freq: np.ndarray) -> None:
        self.lane1 = np.arange(lanes, dtype=np.intp) << T1
        self.lane2 = np.arange(lanes, dtype=np.intp) << T2
        self.lane0 = np.arange(lanes, dtype=I32) << 5
        self.t1 = np.zeros(lanes << T1, dtype=I32)
        self.t2 = np.zeros(lanes << T2, dtype=I32)
        # by confidence of order 2, of order 1, and whether both predict the same
        self.w2 = np.tile(np.repeat(np.array([0, 20000, 40000, 56000], I32), 8), lanes)
        self.w1 = np.tile(np.tile(np.outer([0, 12000, 28000, 48000], [1, 0]).ravel().astype(I32), 4), lanes)
        self.hash = np.zeros(lanes, dtype=np.uint32)
        self.older = np.zeros(lanes, dtype=np.uint32)
        self.cum = np.concatenate([[0, 0], np.cumsum(freq.astype(np.int64))])[:-1].astype(U64)
        self.freq = np.concatenate([[0], freq]).astype(U64)

    def predict(self, n: int) -> None:
        """For the first n blocks: predicted ranks, and the weights of orders 2 and 1."""
        h = self.hash[:n]
        self.i1 = (h >> np.uint32(32 - T1)) + self.lane1[:n]
        self.i2 = ((h + self.older[:n]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - T2)) + self.lane2[:n]
        self.e1, self.e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        i0 = ((self.e2 & 3) << 3) + ((self.e1 & 3) << 1)
        i0 += self.p1 == self.p2
        i0 += self.lane0[:n]
        self.i0 = i0.astype(np.intp)
        self.a2, self.q1 = self.w2.take(self.i0), self.w1.take(self.i0)
        self.a1 = np.minimum(self.q1, MOST - self.a2)

    def update(self, rank: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, n: int) -> None:
        """hit1: order 1 was right and order 2 wasn't."""
        self.w2[self.i0] = self.a2 + (hit2 * GAIN - (self.a2 >> 5))
        self.w1[self.i0] = self.q1 + (hit1 * GAIN - (self.q1 >> 5))
        fresh = rank << 2
        sure = fresh | 3
        fresh |= 1
        self.t2[self.i2] = np.where(hit2, np.minimum(self.e2 + 1, sure), fresh)
        self.t1[self.i1] = np.where(self.p1 == rank, np.minimum(self.e1 + 1, sure), fresh)
        self.older[:n] = self.hash[:n] * np.uint32(0x9E3779B1)
        self.hash[:n] = rank.view(np.uint32) * np.uint32(0x9E3779B1)


def _layout(n: int) -> tuple[int, int]:
    """Blocks, and ids in the last one."""
    lanes = max(1, -(-n // BLOCK))
    return lanes, n - (lanes - 1) * BLOCK


def _carry(flat: np.ndarray, at: np.ndarray) -> None:
    """Add 1 to these digits, and to those before them that overflow. A block's first digit never does."""
    while len(at):
        flat[at] += np.uint32(1)
        at = at[flat[at] == 0] - 1


def encode_group(ids: np.ndarray) -> bytes:
    """A group of blocks as bytes: header, a row a block (ids, words, crc32), the words."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n = len(ids)
    if not n:
        return np.zeros(3, "<u4").tobytes()
    values, freq, bits, rank = _order0(ids)
    lanes, last = _layout(n)
    grid = np.zeros(lanes * BLOCK, dtype=I32)
    grid[:n] = rank + 1
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    m = _Model(lanes, freq)
    low, rng = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    out = np.zeros((lanes, BLOCK + 4), dtype=np.uint32)
    flat, width = out.reshape(-1), BLOCK + 4
    base = np.arange(lanes, dtype=I64) * width
    end = base.copy()
    _b = U64(bits)
    for k in range(BLOCK):
        live = lanes if k < last else lanes - 1
        if not live:
            break
        r = grid[k, :live]
        m.predict(live)
        hit2 = m.p2 == r
        hit1 = (m.p1 == r) & ~hit2
        a2, a1 = m.a2.astype(U64), m.a1.astype(U64)
        unit = rng[:live] >> _W
        # order 2 owns [0, a2), order 1 [a2, a2 + a1), order 0 the rest
        both = a2 + a1
        unit0 = (unit * (_ALL - both)) >> _b
        start = unit * both + unit0 * m.cum.take(r)
        size = unit0 * m.freq.take(r)
        i = np.flatnonzero(m.p2 == r)
        start[i], size[i] = U64(0), unit[i] * a2[i]
        i = np.flatnonzero(hit1)
        start[i], size[i] = unit[i] * a2[i], unit[i] * a1[i]
        lo = low[:live] + start
        over = np.flatnonzero(lo < start)
        if len(over):
            _carry(flat, end[over] - 1)
        i = np.flatnonzero(size < _LOW)
        if len(i):
            l = lo[i]
            p = end[i]
            flat[p] = l >> _S32
            end[i] = p + 1
            lo[i] = l << _S32
            size[i] <<= _S32
        low[:live], rng[:live] = lo, size
        m.update(r, hit2, hit1, live)
    for _ in range(2):
        flat[end] = low >> _S32
        end += 1
        low = low << _S32
    at = end - base
    words = out[np.arange(width) < at[:, None]].astype("<u4")
    sizes = np.full(lanes, BLOCK, dtype="<u4")
    sizes[-1] = last
    raw = ids.tobytes()
    crcs = np.array([zlib.crc32(raw[i * BLOCK * 4 : (i * BLOCK + int(s)) * 4]) for i, s in enumerate(sizes)], dtype="<u4")
    head = np.array([lanes, len(values), bits], dtype="<u4")
    return b"".join(x.tobytes() for x in (head, values.astype("<u4"), freq.astype("<u4"), sizes, at.astype("<u4"), crcs, words))


def decode_group(data: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a group, or of some of its blocks; a wrong checksum raises."""
    lanes, n_values, bits = (int(x) for x in np.frombuffer(data, "<u4", 3))
    if not lanes:
        return np.zeros(0, "<u4")
    at = 12
    parts = []
    for n in (n_values, n_values, lanes, lanes, lanes):
        parts.append(np.frombuffer(data, "<u4", n, at))
        at += 4 * n
    values, freq, sizes, counts, crcs = parts
    words = np.concatenate([np.frombuffer(data, "<u4", int(counts.sum()), at), np.zeros(2, "<u4")]).astype(U64)
    first = np.concatenate([[0], np.cumsum(counts.astype(I64))])[:-1]
    if blocks is not None:
        pick = np.array(blocks, dtype=I64)
        sizes, first, crcs, lanes = sizes[pick], first[pick], crcs[pick], len(pick)
    if not lanes:
        return np.zeros(0, "<u4")
    # only the last block can be shorter than the others
    last = int(sizes[-1])
    longest = int(sizes.max())
    m = _Model(lanes, freq)
    find = np.repeat(np.arange(1, n_values + 1, dtype=I32), freq.astype(I64))
    code = (words[first] << _S32) | words[first + 1]
    ptr = first + 2
    rng = np.full(lanes, 2**64 - 1, U64)
    out = np.zeros((longest, lanes), dtype=I32)
    _b, top = U64(bits), I64((1 << bits) - 1)
    for k in range(longest):
        live = lanes if k < last else lanes - 1
        m.predict(live)
        a2, a1 = m.a2.astype(U64), m.a1.astype(U64)
        unit = rng[:live] >> _W
        c = code[:live]
        both = a2 + a1
        end1 = unit * both
        unit0 = (unit * (_ALL - both)) >> _b
        above = c - end1  # wraps round where order 2 or 1 was right
        slot = np.minimum((above // unit0).view(I64), top)
        short = np.flatnonzero(c < end1)
        slot[short] = 0
        rank = find.take(slot)
        size = unit0 * m.freq.take(rank)
        c = above - unit0 * m.cum.take(rank)
        hit2 = np.zeros(live, dtype=bool)
        hit1 = np.zeros(live, dtype=bool)
        if len(short):
            cs, end2 = code[short], unit[short] * a2[short]
            two = cs < end2
            hit2[short], hit1[short] = two, ~two
            rank[short] = np.where(two, m.p2[short], m.p1[short])
            c[short] = np.where(two, cs, cs - end2)
            size[short] = np.where(two, end2, end1[short] - end2)
        i = np.flatnonzero(size < _LOW)
        if len(i):
            p = ptr[i]
            c[i] = (c[i] << _S32) | words[np.minimum(p, len(words) - 1)]
            ptr[i] = p + 1
            size[i] <<= _S32
        code[:live], rng[:live] = c, size
        out[k, :live] = rank
        m.update(rank, hit2, hit1, live)
    ids = values[np.maximum(out.T.reshape(-1) - 1, 0)]
    keep = (np.arange(longest)[None, :] < sizes[:, None]).reshape(-1)
    ids = ids[keep].astype("<u4")
    raw, a = ids.tobytes(), 0
    for s, crc in zip(sizes, crcs):
        if zlib.crc32(raw[a : a + 4 * int(s)]) != int(crc):
            raise ValueError("a block of token ids doesn't match its checksum")
        a += 4 * int(s)
    return ids
