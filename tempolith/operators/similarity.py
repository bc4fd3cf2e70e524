"""String and vector similarities, each under its own name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words without weight in token overlap: fixed values.
STOP_WORDS = ("the", "a", "an", "is", "are", "of", "in", "to", "for", "and", "or", "be", "with", "on", "at", "by", "this", "that", "it")


def lev_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def words(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: F.length(t) > 0)


def token_overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of distinct words, letters, digits and underscores of any script, without stop words; 0 if either has none."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    x, y = (F.array_except(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)), stop) for c in (a, b))
    small = F.least(F.size(x), F.size(y))
    return F.coalesce(F.when(small > 0, F.size(F.array_intersect(x, y)) / small), F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    n = F.size(F.array_union(x, y))
    return F.coalesce(F.when(n > 0, F.size(F.array_intersect(x, y)) / n), F.lit(0.0))


def fuzzy_confidence(a: Column, b: Column) -> Column:
    """How likely two different names are one: by edit distance over the shorter length, for names longer than five
    with word overlap. 0 for equal names, and for a short name that the other begins with."""
    short = F.least(F.length(a), F.length(b))
    distance = F.levenshtein(a, b)
    lev = 1 - distance / F.greatest(short, F.lit(1))
    x, y = words(a), words(b)
    n = F.least(F.size(x), F.size(y))
    shared = F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)
    score = F.when(short <= 5, lev).otherwise(0.6 * lev + 0.4 * shared)
    prefix = F.startswith(a, b) | F.startswith(b, a)
    return F.when((distance == 0) | (prefix & (short < 4)), 0.0).otherwise(score)


def label_similarity(a: Column, b: Column) -> Column:
    """1 for labels that are equal after their first underscore, else the Jaccard index of all their parts between
    underscores; four digits."""
    from ..functions.strings import label_suffix

    x, y = (F.array_distinct(F.split(F.lower(c), "_")) for c in (a, b))
    both = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when(label_suffix(a) == label_suffix(b), 1.0).otherwise(F.round(both, 4))


def signature_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of names: 0.6 Jaccard + 0.4 (1 - difference in size / larger size); 0 if either is empty."""
    x, y = (F.array_distinct(F.transform(c, lambda n: F.lower(n))) for c in (a, b))
    j = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    size = 1 - F.abs(F.size(x) - F.size(y)) / F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 0.6 * j + 0.4 * size).otherwise(0.0)


def charset_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the character sets, raised by up to four common leading characters."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda t: F.length(t) > 0)) for c in (a, b))
    n = F.size(F.array_union(x, y))
    j = F.coalesce(F.when(n > 0, F.size(F.array_intersect(x, y)) / n), F.lit(0.0))
    lead = F.lit(0)
    same = F.lit(True)
    for i in range(1, 5):
        same = same & (F.substring(F.lower(a), i, 1) == F.substring(F.lower(b), i, 1)) & (F.length(a) >= i)
        lead = lead + same.cast("int")
    return F.least(j + 0.1 * lead * (1 - j), F.lit(1.0))


# --- Jaro-Winkler: not among the built-in functions -------------------------------------------------


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m, t = len(mine), sum(x != y for x, y in zip(mine, other)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler_py(a: str | None, b: str | None, scale: float = 0.1) -> float | None:
    if a is None or b is None:
        return None
    j = _jaro(a, b)
    p = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        p += 1
    return j + p * scale * (1 - j) if j > 0.7 else j


def jaro_winkler(a: Column, b: Column) -> Column:
    """Arrow batches; each distinct pair of a batch is computed once."""
    import pandas as pd

    @F.pandas_udf("double")
    def run(x, y):
        seen: dict = {}
        out = []
        for k in zip(x, y):
            if k not in seen:
                seen[k] = jaro_winkler_py(*k)
            out.append(seen[k])
        return pd.Series(out, dtype="float64")

    return run(a, b)


def weighted_fields(name_score: Column, description_score: Column, name: float = 0.7, description: float = 0.3) -> Column:
    """Weighted mean of a name's and a description's similarity; only the name's if there is no description."""
    return F.when(description_score.isNull(), name_score).otherwise((name * name_score + description * description_score) / (name + description))


# --- vectors ------------------------------------------------------------------------------------------


def similar_pairs(a: DataFrame, b: DataFrame, key: str, vector: str, threshold: float, block: int = 2048) -> DataFrame:
    """Pairs of vectors of two tables with cosine of at least the threshold, exactly.

    Both tables are cut into blocks of about ``block`` vectors; each pair of blocks is one matrix product, so no
    task holds more than two blocks, however large the tables are. The work is that of all pairs.
    """
    import numpy as np
    import pandas as pd

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == "a"], pdf[pdf["side"] == "b"]
        parts = []
        for at, s in _cosines(x, y):
            i, j = np.nonzero(s >= threshold)
            parts.append(pd.DataFrame({"a": x["k"].to_numpy()[at + i], "b": y["k"].to_numpy()[j], "score": s[i, j]}))
        return pd.concat(parts) if parts else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})

    return _dealt(a, b, key, vector, block).groupBy("i", "j").applyInPandas(meet, "a long, b long, score double")


def best_by_label(a: DataFrame, b: DataFrame, key: str, vector: str, label: str, block: int = 2048) -> DataFrame:
    """(a, label, score): the greatest cosine of each vector of ``a`` with those of ``b`` that have a whole-numbered label, null among them.

    All pairs are scored as by ``similar_pairs``, but a task returns a row a vector and label, not one a pair.
    """
    import numpy as np
    import pandas as pd

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == "a"], pdf[pdf["side"] == "b"].sort_values("label")
        starts = np.flatnonzero(~y["label"].duplicated().to_numpy())
        labels = [None if pd.isna(v) else int(v) for v in y["label"].to_numpy()[starts]]
        parts = [pd.DataFrame({"a": np.repeat(x["k"].to_numpy()[at : at + len(s)], len(labels)), "label": pd.array(labels * len(s), dtype="Int64"), "score": np.maximum.reduceat(s, starts, axis=1).ravel()}) for at, s in _cosines(x, y)]
        return pd.concat(parts) if parts else pd.DataFrame({"a": np.zeros(0, np.int64), "label": pd.array([], dtype="Int64"), "score": np.zeros(0)})

    best = _dealt(a, b, key, vector, block, label).groupBy("i", "j").applyInPandas(meet, "a long, label long, score double")
    return best.groupBy("a", "label").agg(F.max("score").alias("score")).withColumn("label", F.col("label").cast(b.schema[label].dataType))


def _dealt(a: DataFrame, b: DataFrame, key: str, vector: str, block: int, label: str | None = None) -> DataFrame:
    """(side, k, v, label, i, j): blocks of both tables, each copied to all blocks of the other one."""
    own = F.col(label).cast("long") if label else F.lit(None).cast("long")
    a, b = (t.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), x.alias("label")) for t, x in ((a, F.lit(None).cast("long")), (b, own)))
    rows, columns = (max(1, -(-t.count() // block)) for t in (a, b))

    def dealt(t: DataFrame, side: str, own: str, n: int, other: str, m: int) -> DataFrame:
        d = t.withColumn("side", F.lit(side)).withColumn(own, F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("side", "k", "v", "label", "i", "j")

    return dealt(a, "a", "i", rows, "j", columns).unionByName(dealt(b, "b", "j", columns, "i", rows))


def _cosines(x, y, slice_rows: int = 128):
    """Cosines of vectors of two frames, some rows of the first at a time: (first row, matrix)."""
    import numpy as np

    if not len(x) or not len(y):
        return
    o = np.stack(y["v"].to_numpy()).astype(np.float64)
    length = np.linalg.norm(o, axis=1)[None, :]
    for at in range(0, len(x), slice_rows):
        m = np.stack(x["v"].to_numpy()[at : at + slice_rows]).astype(np.float64)
        norm = np.linalg.norm(m, axis=1)[:, None] * length
        yield at, np.divide(m @ o.T, norm, out=np.zeros_like(norm), where=norm > 0)
