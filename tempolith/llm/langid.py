"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased; runs of anything but letters become one space; letters beyond the ``LETTERS`` most
frequent ones of the sample share a code. Each language has a 4-gram model: the counts of the highest order,
continuation counts below it, an absolute discount n1 / (n1 + 2 n2) in each order, all interpolated down to a
uniform distribution. The models' n-grams are merged into one array of sorted 32-bit hashes an order (the hash
is a bijection, so none collide), with the log probabilities of all languages beside each; one search finds
those of an n-gram in every language. A text's language has the least cross-entropy a character.

Rejection is calibrated on documents of the sample that the models haven't seen: a text is rejected if its
cross-entropy exceeds its language's mean by more than any of these did, scaled to its length, with a margin.
A language with few such documents has its mean from all of its own in turn, each by a model of the others (of a
single one's halves), and its bound from the excesses of all languages.

The sample is bounded: about ``sample_docs`` whole documents a language, chosen by a hash of doc_id, of which
each model uses ``sample_chars`` characters' worth; see ``sample`` for its other bounds. Every document is scored over its whole text.

Defined cases: null text and text without letters give ``und`` with score 0 and are rejected; so does any text
if nothing could be learned; ties go to the language first in order; repeated rows each have their row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lean

ORDER = 4
LETTERS = 250
OTHER = LETTERS + 1
V = OTHER + 1
UNKNOWN = "und"
#: Characters scored at once.
AT_ONCE = 500_000
#: Unseen documents from which a language is calibrated by these alone.
FEW = 20


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    import sys

    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(texts: list[str]) -> np.ndarray:
    """Code of every code point: 0 for no letter, then the letters by how often they are used."""
    counts = np.zeros(0x110000, np.int64)
    for t in texts:
        p = _points(t)
        if len(p):
            c = np.bincount(p)
            counts[: len(c)] += c
    letters = _is_letter()
    counts[~letters] = 0
    top = np.lexsort((np.arange(len(counts)), -counts))[:LETTERS]
    top = top[counts[top] > 0]
    table = np.where(letters, OTHER, 0).astype(np.uint8)
    table[top] = np.arange(1, len(top) + 1)
    return table


def coded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram keys of all characters, document of each, letters a document)."""
    parts, sizes, letters = [], [], []
    pad = np.zeros(ORDER - 1, np.uint8)
    for t in texts:
        c = table.take(_points(t)) if t else pad[:0]
        keep = c != 0
        letters.append(int(np.count_nonzero(keep)))
        keep[1:] |= c[:-1] != 0  # one space after each run
        c = c[keep]
        parts += [pad, c]
        sizes.append(len(c))
    c = np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
    if len(c) < ORDER:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.array(letters, np.int64)
    key = (c[:-3] << np.uint32(24)) | (c[1:-2] << np.uint32(16)) | (c[2:-1] << np.uint32(8)) | c[3:]
    sizes = np.array(sizes, np.int64)
    # the keys whose last character is a document's own, not padding
    at = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    first = np.repeat(at, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return key[first], np.repeat(np.arange(len(texts)), sizes), np.array(letters, np.int64)


def _hash(key: np.ndarray) -> np.ndarray:
    return key.astype(np.uint32) * np.uint32(0x9E3779B1)


class KneserNey:
    """Counts of one language, and its probabilities for any n-grams."""

    def __init__(self, keys: np.ndarray) -> None:
        self.grams, self.counts, self.discount, self.context = {}, {}, {}, {}
        g, n = np.unique(keys, return_counts=True)
        for order in range(ORDER, 0, -1):
            self.grams[order], self.counts[order] = g, n.astype(np.float64)
            n1, n2 = int((n == 1).sum()), int((n == 2).sum())
            self.discount[order] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            # contexts: total and number of continuations
            c, at = np.unique(g >> np.uint32(8), return_index=True)
            self.context[order] = (c, np.add.reduceat(self.counts[order], at), np.diff(np.append(at, len(g))).astype(np.float64))
            if order > 1:  # how many different characters come before each shorter n-gram
                g, n = np.unique(g & np.uint32((1 << (8 * (order - 1))) - 1), return_counts=True)

    @staticmethod
    def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
        return i, sorted_[i] == keys

    def left_over(self, context: np.ndarray, order: int) -> np.ndarray:
        """What the discount leaves to the lower order; all of it after an unseen context."""
        c, total, kinds = self.context[order]
        i, ok = self._find(c, context)
        return np.where(ok, self.discount[order] * kinds[i] / total[i], 1.0)

    def probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 1.0 / V)
        keys = keys & np.uint32((1 << (8 * order)) - 1)
        c, total, _ = self.context[order]
        i, ok = self._find(self.grams[order], keys)
        j, seen = self._find(c, keys >> np.uint32(8))
        own = np.where(ok & seen, np.maximum(self.counts[order][i] - self.discount[order], 0) / total[j], 0.0)
        return own + self.left_over(keys >> np.uint32(8), order) * self.probability(keys, order - 1)


class Model:
    """All languages' models, merged."""

    def __init__(self, names: list[str], models: list[KneserNey], table: np.ndarray) -> None:
        self.names, self.table = names, table
        logs = lambda x: np.log(np.stack(x, axis=1)).astype(np.float32)
        self.hashes, self.logp = {}, {}
        for order in (4, 3):
            keys = np.unique(np.concatenate([m.grams[order] for m in models]))
            self._put(("p", order), keys, logs([m.probability(keys, order) for m in models]))
        contexts = np.unique(np.concatenate([m.context[4][0] for m in models]))
        self._put(("left", 4), contexts, logs([m.left_over(contexts, 4) for m in models]))
        pairs = np.arange(1 << 16, dtype=np.uint32)
        self.left3 = logs([m.left_over(pairs, 3) for m in models])
        self.p2 = logs([m.probability(pairs, 2) for m in models])
        self.mean = np.zeros(len(names))
        self.reach = np.full(len(names), np.inf)

    def _put(self, name, keys: np.ndarray, logs: np.ndarray) -> None:
        h = _hash(keys)
        order = np.argsort(h)
        self.hashes[name], self.logp[name] = h[order], logs[order]

    def _get(self, name, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _hash(keys)
        i = np.minimum(np.searchsorted(self.hashes[name], h), len(self.hashes[name]) - 1)
        return self.logp[name].take(i, axis=0), self.hashes[name].take(i) == h

    def _third(self, keys: np.ndarray) -> np.ndarray:
        keys = keys & np.uint32(0xFFFFFF)
        logs, ok = self._get(("p", 3), keys)
        miss = np.flatnonzero(~ok)
        if len(miss):
            k = keys[miss]
            logs[miss] = self.left3.take(k >> np.uint32(8), axis=0) + self.p2.take(k & np.uint32(0xFFFF), axis=0)
        return logs

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """A row a character, a column a language."""
        logs, ok = self._get(("p", 4), keys)
        miss = np.flatnonzero(~ok)
        if len(miss):
            k = keys[miss]
            left, seen = self._get(("left", 4), k >> np.uint32(8))
            left[~seen] = 0
            logs[miss] = left + self._third(k)
        return logs

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a character, a column a language; characters; letters) of whole texts."""
        n, total = len(texts), np.zeros((len(texts), len(self.names)))
        chars, letters = np.zeros(n, np.int64), np.zeros(n, np.int64)
        a = 0
        while a < n:
            b, size = a, 0
            while b < n and (b == a or size + len(texts[b] or "") <= AT_ONCE):
                size += len(texts[b] or "")
                b += 1
            key, doc, letters[a:b] = coded([t or "" for t in texts[a:b]], self.table)
            for x in range(0, len(key), AT_ONCE):  # a very long text is summed in steps
                k, d = key[x : x + AT_ONCE], doc[x : x + AT_ONCE]
                at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                total[a + d[at]] += np.add.reduceat(self.log_probabilities(k), at, axis=0, dtype=np.float64)
                chars[a:b] += np.bincount(d, minlength=b - a)
            a = b
        return -total / np.maximum(chars, 1)[:, None], chars, letters

    def _excess(self, h: np.ndarray, best: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return (h - self.mean[best]) * np.sqrt(np.minimum(chars, 400))

    def calibrate(self, texts: list[str], langs: list[str], crossed: dict[str, tuple[np.ndarray, np.ndarray]], margin: float = 3.0) -> None:
        """Mean and reach of each language from unseen texts; ``crossed`` has entropies and sizes for those with few."""
        h, chars, letters = self.entropies(texts)
        own = np.array([self.names.index(x) for x in langs], np.int64)
        ok = letters > 0
        h, chars, own = h[np.arange(len(own)), own][ok], chars[ok], own[ok]
        seen = {i: crossed[x] if x in crossed else (h[own == i], chars[own == i]) for i, x in enumerate(self.names)}
        for i, (x, n) in seen.items():
            if len(x):
                self.mean[i] = np.average(x, weights=np.minimum(n, 400))
        some = [i for i, (x, _) in seen.items() if len(x)]
        for i in set(seen) - set(some):  # a few letters in all: no language is worse than the worst known, or than chance
            self.mean[i] = max(self.mean[some]) if some else np.log(V)
        most = {i: self._excess(seen[i][0], np.full(len(seen[i][0]), i), seen[i][1]).max() for i in some}
        for i, x in enumerate(self.names):
            self.reach[i] = margin * max([1.0, *most.values()] if x in crossed else [1.0, most[i]])

    def predict(self, texts: list[str | None]):
        """(language, score, cross-entropy, rejected) of each."""
        h, chars, letters = self.entropies(texts)
        best = np.argmin(h, axis=1)
        least = h[np.arange(len(h)), best]
        score = 1 / np.exp(-(h - least[:, None]) * np.minimum(chars, 100)[:, None]).sum(axis=1)
        some = letters > 0
        rejected = ~some | (self._excess(least, best, chars) > self.reach[best])
        langs = [self.names[i] if s else UNKNOWN for i, s in zip(best.tolist(), some.tolist())]
        return langs, np.where(some, score, 0.0), least, rejected


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, sample_docs: int, sample_chars: int, sample_total: int = 20_000, total_chars: int = 60_000_000) -> DataFrame:
    """About ``sample_docs`` documents a language, and about ``sample_total`` in all, from those that aren't held out.

    Of these, in a hashed order, as many of each language as have ``sample_chars`` characters, and
    ``total_chars`` in all: a bound on what the driver gets. Documents beyond a fifth of their language's
    characters aren't learned from.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return known.select("lang", "text").limit(0)
    sample_docs = min(sample_docs, sample_total / len(sizes))
    chars = min(sample_chars, total_chars // len(sizes))
    part = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))]), F.col("lang"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11) / F.lit(float(2**53))
    few = known.filter((F.length("text") <= chars // 5) & (place < part)).select("lang", "text", place.alias("place"))
    line = Window.partitionBy("lang").orderBy("place", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    return few.withColumn("_chars", F.sum(F.length("text").cast("long")).over(line)).filter(F.col("_chars") <= chars).drop("_chars")


def _crossed(texts: list[str], table: np.ndarray, sample_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy, characters) of each text by a model of the others: of four fifths, or all but one if they are fewer."""
    texts = [t for t in texts if t and coded([t], table)[2][0]]
    if len(texts) == 1:
        texts = [texts[0][: len(texts[0]) // 2], texts[0][len(texts[0]) // 2 :]]
    out = []
    for fold in range(min(5, len(texts))):
        used, rest = 0, []
        for t in [t for i, t in enumerate(texts) if i % 5 != fold]:
            if used < sample_chars:
                used += len(t)
                rest.append(t)
        keys = coded(rest, table)[0]
        if not len(keys):
            continue
        model = KneserNey(keys)
        for t in texts[fold::5]:
            k, _, letters = coded([t], table)
            if letters[0]:
                out.append((-np.log(model.probability(k, ORDER)).mean(), len(k)))
    return np.array([h for h, _ in out]), np.array([n for _, n in out], np.int64)


def fit(docs: DataFrame, sample_docs: int = 600, sample_chars: int = 1_500_000) -> Model | None:
    """Models of all languages of ``docs`` (doc_id, text, lang); None if there is nothing to learn from."""
    rows = sorted(((r["lang"], r["place"], r["text"]) for r in sample(docs, sample_docs, 5 * sample_chars // 4).collect()), key=lambda r: r[:2]) if "lang" in docs.columns else []
    by: dict[str, list[str]] = {}
    for lang, _, text in rows:
        by.setdefault(lang, []).append(text)
    learn, check = {}, []
    for lang, texts in by.items():
        used, mine = 0, []
        for i, t in enumerate(texts):
            if i % 5 == 4:
                check.append((lang, t))
            elif used < sample_chars:
                used += len(t)
                mine.append(t)
        learn[lang] = mine
    if not learn:
        return None
    table = alphabet([t for ts in learn.values() for t in ts])
    keys = {k: coded(ts, table)[0] for k, ts in learn.items()}
    names = sorted(k for k, x in keys.items() if len(x))
    if not names:
        return None
    m = Model(names, [KneserNey(keys[k]) for k in names], table)
    check = [(k, t) for k, t in check if k in names]
    few = [k for k in names if sum(x == k and bool(coded([t], table)[2][0]) for x, t in check) < FEW]
    m.calibrate([t for _, t in check], [k for k, _ in check], {k: _crossed(by[k], table, sample_chars) for k in few})
    return m


def _score_tasks(shared):
    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in (x for whole in batches for x in chunks(whole, 4_000_000)):
            texts = b.column("text").to_pylist()
            if m is None:
                langs, score, h, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                langs, score, h, rejected = m.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns)], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*b.schema.names, "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected; only ``text`` is looked at."""
    from pyspark.sql import types as T

    taken = [c for c in docs.columns if c.lower() in ("lang_pred", "score", "cross_entropy", "rejected")]
    docs = docs.drop(*taken)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("lang_pred string, score double, cross_entropy double, rejected boolean").fields])
    return docs.mapInArrow(lean(_score_tasks(docs.sparkSession.sparkContext.broadcast(model))), schema)
