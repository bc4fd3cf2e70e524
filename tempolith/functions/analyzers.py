"""Analyzers: what a text is cut into before it is indexed or compared. Each takes a Column and gives an array, and
``pipeline`` chains them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]

#: Letters with accents and what is left without these: fixed values, position by position.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_BARE = "aaaaaaceeeeiiiinoooooouuuuyy"


def identity(text: Column) -> Column:
    return F.array(text)


def text_tokens(text: Column) -> Column:
    """Small letters and digits; everything else separates."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 0)


def delimiter(by: str) -> Analyzer:
    """Parts between occurrences of a string."""
    return lambda text: F.split(text, r"\Q" + by + r"\E")


def multi_delimiter(by: list[str]) -> Analyzer:
    """Parts between occurrences of any of some strings."""
    return lambda text: F.split(text, "|".join(r"\Q" + x + r"\E" for x in sorted(by, key=len, reverse=True)))


def norm(case: str = "lower", accent: bool = False) -> Analyzer:
    """The whole value in one case; without accents, unless ``accent`` keeps them."""

    def run(text: Column) -> Column:
        t = {"lower": F.lower, "upper": F.upper, "none": lambda x: x}[case](text)
        if not accent:
            t = F.translate(t, _ACCENTED + _ACCENTED.upper(), _BARE + _BARE.upper())
        return F.array(t)

    return run


def ngrams(low: int, high: int, preserve: bool = False) -> Analyzer:
    """All runs of ``low`` to ``high`` characters, by where they begin; ``preserve`` adds the whole value."""

    def run(text: Column) -> Column:
        n = F.length(text)
        size = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        out = F.concat(*[size(k) for k in range(low, high + 1)])
        return F.concat(out, F.array(text)) if preserve else out

    return run


def edge_ngrams(low: int, high: int) -> Analyzer:
    """The first ``low`` to ``high`` characters of a value, as far as it has so many."""

    def run(text: Column) -> Column:
        sizes = F.filter(F.array(*[F.lit(k) for k in range(low, high + 1)]), lambda k: k <= F.length(text))
        return F.transform(sizes, lambda k: F.substring(text, F.lit(1), k))

    return run


def stopwords(words: list[str]) -> Callable[[Column], Column]:
    """Takes tokens out of an array."""
    stop = F.array(*[F.lit(w) for w in words])
    return lambda tokens: F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def pipeline(*steps: Analyzer) -> Analyzer:
    """Each step is applied to every token of the one before."""

    def run(text: Column) -> Column:
        tokens = F.array(text)
        for s in steps:
            tokens = F.flatten(F.transform(tokens, s))
        return tokens

    return run


def ngram_similarity(a: Column, b: Column, n: int) -> Column:
    """How many of the longer text's distinct n-grams the texts share, from 0 to 1."""
    x, y = F.array_distinct(ngrams(n, n)(a)), F.array_distinct(ngrams(n, n)(b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(0.0)


def ngram_match(target: Column, text: Column, threshold: float, n: int) -> Column:
    """Whether ``text`` has the given share of the target's distinct n-grams."""
    x = F.array_distinct(ngrams(n, n)(target))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, ngrams(n, n)(text))) / F.size(x) >= threshold).otherwise(False)


def matched(*conditions: Column) -> Column:
    """How many of some conditions hold; null counts as false."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def exists(value: Column) -> Column:
    """Whether a field has a value that isn't null."""
    return value.isNotNull()
