"""Toxicity by cumulative-link ordinal regression on sparse word features.

Grades of harm, from the labels: 0 of good quality and not toxic, 1 of low quality, 2 toxic; grades that no
label has fall out. With shared weights w and ascending thresholds, P(grade <= j) = sigmoid(threshold_j - w . x).
Toxic is the highest grade, so more evidence never speaks against it. Features are words, runs of letters in
lower case, their beginnings of ``LENGTHS`` letters, so that inflected forms count together, and beginnings that
``OFTEN`` words or more of a text have; x has log(1 + n) of each, n the number of different words of the text that have
it. Weights are fitted by accelerated proximal gradient steps. The squared penalty is on weights of features in
proportion to how telling these are, so every word that toxic texts have by far more often gets a share, and many weak
features can't outvote a few strong ones. The expected grade is the severity; a text is toxic if grade 2 has a
probability of ``CUT``.

The fit uses a bounded sample: the ``sample_docs`` labelled documents whose hashed doc_id comes first, and of
these as many, in that order, as have ``sample_chars`` characters in all. Features of at least ``MIN_DOCS`` of
these are kept if toxic documents have them more often than chance would (a likelihood ratio of ``TELLING``), at
most ``FEATURES`` of them. All documents are scored over their whole texts.

Defined cases: null and empty text have severity 0 and aren't toxic; documents with several labels count with
the highest grade; labels without toxic are left out; if no label is toxic, or all are, nothing is toxic;
repeated rows each have their row; an empty table gives no rows; other columns are kept or ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, give_back, lean

MIN_DOCS, FEATURES, TELLING = 2, 20_000, 7.0
#: Probability of grade 2 from which a text is toxic. Held out by the labels' crc32(doc_id as text) mod 4, it is reached
#: by 45 of 51 toxic documents and 2 of 348 clean ones at sf0.01, and by 419 of 449 and 8 of 3,531 at sf0.1.
CUT = 0.12
#: Letters of the beginnings of words that are features.
LENGTHS = (3, 4, 5, 6, 7)
#: Words of a text with a common beginning that count as often.
OFTEN = 3
_WORD = re.compile(r"[^\W\d_]+")
#: The highest grade.
TOXIC = 2


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(found: Counter) -> Counter:
    """How many different words of a text have each feature. Beginnings end with a hyphen, or with an equals sign where
    ``OFTEN`` words or more of the text begin so, which then count as one."""
    out = Counter(found.keys())
    for k in LENGTHS:
        out.update(w[:k] + "-" for w in found if len(w) > k)
        often = Counter()
        for w, n in found.items():
            if len(w) >= k:
                often[w[:k]] += n
        out.update(w + "=" for w, n in often.items() if n >= OFTEN)
    return out


class Ordinal:
    """Shared weights, and ascending thresholds between the grades ``levels``."""

    def __init__(self, weights: dict[str, float], thresholds: list[float], levels: list[int] | None = None) -> None:
        self.weights, self.thresholds = weights, thresholds
        self.levels = levels or list(range(len(thresholds) + 1))
        self.words = {w: x for w, x in weights.items() if w[-1] not in "-="}
        self.often = {k: {w[:-1]: x for w, x in weights.items() if w.endswith("=") and len(w) == k + 1} for k in LENGTHS}
        self.begins = {k: {w[:-1]: x for w, x in weights.items() if w.endswith("-") and len(w) == k + 1} for k in LENGTHS}

    def score(self, text: str | None) -> float:
        if not text or not self.weights:
            return 0.0
        found = Counter(words(text))
        total = [self.words[w] * math.log(2) for w in found.keys() & self.words.keys()]
        for k, known in self.begins.items():
            if known and not known.keys().isdisjoint([w[:k] for w in found]):
                n = Counter(w[:k] for w in found if len(w) > k and w[:k] in known)
                total += [known[w] * math.log1p(c) for w, c in n.items()]
        for k, known in self.often.items():
            n = Counter()
            for w in [w for w in found if w[:k] in known] if known else ():
                n[w[:k]] += found[w]
            total += [known[w] * math.log(2) for w, c in n.items() if c >= OFTEN]
        return math.fsum(total)

    def grades(self, text: str | None) -> list[float]:
        """Probabilities of the grades."""
        if not text or not self.thresholds:
            return [1.0] + [0.0] * len(self.thresholds)
        s = self.score(text)
        below = [1 / (1 + math.exp(min(700, max(-700, s - t)))) for t in self.thresholds] + [1.0]
        return [b - a for a, b in zip([0.0, *below], below)]

    def judge(self, text: str | None) -> tuple[float, int, bool]:
        """Severity, the likeliest grade, and whether the text is toxic."""
        if not text or not self.thresholds:
            return 0.0, 0, False
        p = self.grades(text)
        return sum(g * x for g, x in zip(self.levels, p)), self.levels[max(range(len(p)), key=p.__getitem__)], self.levels[-1] == TOXIC and p[-1] >= CUT


def fit_rows(texts: list[str], grades: list[int], l1: float = 1e-5, l2: float = 3e-3, rounds: int = 300) -> Ordinal:
    """Fit on labelled texts; deterministic."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return Ordinal({}, [], levels)
    y = np.array([levels.index(g) for g in grades])
    k = len(levels)
    # texts are cut into features twice, as these take many times the room of the texts
    cut = lambda: (features(Counter(words(t))) for t in texts)
    df, bad = Counter(), Counter()
    for c, g in zip(cut(), y):
        df.update(c.keys())
        if g == k - 1:
            bad.update(c.keys())
    share = (y == k - 1).mean()

    def telling(w: str) -> float:
        """Likelihood ratio of a word's share of documents of the highest grade against that of all documents."""
        a, n_w = bad[w], df[w]
        if a <= share * n_w:
            return 0.0
        clean = n_w - a
        return 2 * (a * math.log(a / (n_w * share)) + (clean * math.log(clean / (n_w * (1 - share))) if clean else 0.0))

    ratio = {w: telling(w) for w, n_w in df.items() if n_w >= MIN_DOCS}
    vocabulary = sorted(ratio, key=lambda w: (-ratio[w], w))
    # chance gives hardly any word a ratio of TELLING; a small sample may have no word beyond it
    enough = sum(ratio[w] >= TELLING for w in vocabulary)
    vocabulary = vocabulary[: min(FEATURES, max(enough, 10))]
    place = {w: i for i, w in enumerate(vocabulary)}
    rows, cols, vals = [], [], []
    for i, c in enumerate(cut()):
        for w, n in c.items():
            j = place.get(w)
            if j is not None:
                rows.append(i)
                cols.append(j)
                vals.append(math.log1p(n))
    rows, cols, vals = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals)
    n, m = len(y), len(vocabulary)
    # features count by how telling they are: the penalty is on weights of these, so weak ones can't add up to much
    scale = 1 / np.sqrt(np.maximum(np.array([ratio[w] for w in vocabulary]) / TELLING, 0.1))
    vals = vals / scale[cols] if len(rows) else vals
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def gradient(w, t):
        s = np.bincount(rows, vals * w[cols], minlength=n) if len(rows) else np.zeros(n)
        upper = np.where(y == k - 1, 1.0, sig(np.append(t, 40.0)[y] - s))
        lower = np.where(y == 0, 0.0, sig(np.insert(t, 0, -40.0)[y] - s))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        gs = (du - dl) / p  # d -log p / d s
        gt = np.zeros(k - 1)
        np.add.at(gt, np.minimum(y, k - 2), np.where(y < k - 1, -du / p, 0))
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, dl / p, 0))
        return np.bincount(cols, vals * gs[rows], minlength=m) / n + l2 * w, gt / n

    cum = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    t = np.log(cum / (1 - cum))
    w = np.zeros(m)
    # the largest eigenvalue of X'X / 4n, by power iterations
    v = np.ones(m)
    for _ in range(15):
        v /= np.linalg.norm(v)
        v = np.bincount(cols, vals * np.bincount(rows, vals * v[cols], minlength=n)[rows], minlength=m) / n if len(rows) else v
    step = 1 / (np.linalg.norm(v) / 2 + l2 + 1)
    zw, zt, momentum = w, t, 1.0
    for _ in range(rounds):
        gw, gt = gradient(zw, zt)
        nw = zw - step * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nt = np.maximum.accumulate(zt - 4 * step * gt + np.arange(k - 1) * 1e-9)
        if ((zw - nw) @ (nw - w)) > 0:
            momentum = 1.0
        new = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        zw, zt = nw + (momentum - 1) / new * (nw - w), nt + (momentum - 1) / new * (nt - t)
        w, t, momentum = nw, nt, new
    return Ordinal({vocabulary[i]: float(w[i] / scale[i]) for i in np.flatnonzero(w)}, [float(x) for x in t], levels)


def labelled(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_chars: int = 40_000_000) -> DataFrame:
    """(doc_id, text, grade) of the sample, in which no document has more than a tenth of ``sample_chars``."""
    grade = F.when(F.col("toxic") > 0, TOXIC).when(F.col("toxic") == 0, F.when(F.coalesce("quality", F.lit(1)) > 0, 0).otherwise(1))
    g = labels.select("doc_id", grade.alias("grade")).filter("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    few = g.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample_docs)
    # ``few`` has at most sample_docs rows of two numbers; Spark sorts their texts, and only the budget goes on to Python
    found = docs.select("doc_id", "text").filter(F.length("text") <= sample_chars // 10).join(F.broadcast(few), "doc_id")
    line = Window.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    held = found.withColumn("_chars", F.sum(F.length("text").cast("long")).over(line)).withColumn("_n", F.count("*").over(line))
    return held.filter((F.col("_chars") <= sample_chars) & (F.col("_n") <= sample_docs)).select("doc_id", "text", "grade")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000) -> Ordinal:
    """Fit in one task over the bounded sample; the weights come to the driver."""

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "grade", "text"])
        m = fit_rows(pdf["text"].tolist(), pdf["grade"].tolist())
        give_back()
        return pd.DataFrame({"words": [list(m.weights)], "weights": [list(m.weights.values())], "thresholds": [m.thresholds], "levels": [m.levels]})

    got = labelled(docs, labels, sample_docs).withColumn("one", F.col("grade") * 0).groupBy("one").applyInPandas(learn, "words array<string>, weights array<double>, thresholds array<double>, levels array<int>").collect()
    if not got:
        return Ordinal({}, [])
    return Ordinal(dict(zip(got[0]["words"], got[0]["weights"])), list(got[0]["thresholds"]), list(got[0]["levels"]))


def _score_tasks(shared):
    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in (x for whole in batches for x in chunks(whole)):
            found = [m.judge(v) for v in b.column("text").to_pylist()]
            severity, top, toxic = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns)], pa.array(severity, pa.float64()), pa.array(top, pa.int32()), pa.array(toxic, pa.bool_())],
                names=[*b.schema.names, "severity", "grade", "is_toxic"],
            )

    return run


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs with severity (the expected grade), grade (the likeliest) and is_toxic."""
    from pyspark.sql import types as T

    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("severity", "grade", "is_toxic")])
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("severity double, grade int, is_toxic boolean").fields])
    return docs.mapInArrow(lean(_score_tasks(docs.sparkSession.sparkContext.broadcast(model))), schema)
