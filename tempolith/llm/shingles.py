"""Word shingles of whole texts as sorted 64-bit digests, for a batch of documents at once in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number for each byte; white space counts nothing.
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and P ** -i mod 2 ** 64, for i < n."""
    if len(_powers[0]) < n:
        m = 1 << max(20, (n - 1).bit_length())
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(m, p, dtype=U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ U64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(digests of all words, document index of each), A-Z in lower case; only ASCII white space parts words."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    b = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = _SPACE[b]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    power, inverse = _power(len(b))
    digest = np.add.reduceat(_BYTE[b] * power, start) * inverse[start]
    return mix(digest), np.searchsorted(np.cumsum(sizes), start, side="right")


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(digests of distinct shingles, sorted within each document, and how many each document has).

    A document of fewer than k words has one shingle, the whole sequence; one without words has none.
    """
    words, doc = word_digests(texts)
    n_words = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(n_words)
    place = np.arange(len(words)) - (ends - n_words)[doc] if len(words) else np.zeros(0, np.int64)
    h = np.zeros(len(words), U64)
    for j in range(k):  # the j-th word after each; beyond the document's end nothing is added
        ok = place + j < n_words[doc] if len(words) else np.zeros(0, bool)
        shifted = np.zeros(len(words), U64)
        shifted[: max(0, len(words) - j)] = words[j:]
        h = np.where(ok, mix(h * U64(0x9FB21C651E98DF25) + shifted, j), h)
    keep = (place + k <= n_words[doc]) | (place == 0) if len(words) else np.zeros(0, bool)
    h, doc = h[keep], doc[keep]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]) if len(doc) else np.zeros(len(texts) + 1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)


def fast_sketches(h: np.ndarray, n: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, a row of t coordinates a document, as 16-bit digests.

    In round i < t every element falls into a random bin with a value in [i, i + 1); in round t + b it falls
    into bin b, so that every bin of a set that isn't empty fills. A coordinate is the least value in its bin,
    and two sets agree in one with probability equal to their Jaccard index. Rounds end for a document when
    its bins are full, after about t log t elements.
    """
    out = np.full((len(n), t), np.iinfo(np.uint64).max, dtype=U64)
    bits = (2 * t - 1).bit_length()  # the highest bits are the round's; all 2 * t rounds must fit, or late ones would go first
    doc = np.repeat(np.arange(len(n)), n)
    open_ = n > 0
    for i in range(2 * t):
        live = open_[doc]
        if not live.all():
            h, doc = h[live], doc[live]
        if not len(h):
            break
        x = mix(h, i + 1)
        value = (U64(i) << U64(64 - bits)) | (x >> U64(bits))
        bins = (((x & U64(1023)) * U64(0x5851F42D4C957F2D) + (x >> U64(32)) * U64(0x14057B7EF767814F)) >> U64(33)) % U64(t) if i < t else np.full(len(x), i - t, U64)
        np.minimum.at(out.reshape(-1), doc * t + bins.astype(np.int64), value)
        full = np.ones(len(n), dtype=bool)
        some = np.unique(doc)
        full[some] = (out[some] != np.iinfo(np.uint64).max).all(axis=1)
        open_ &= ~full
    return (mix(out, 77) >> U64(48)).astype(np.uint16)
