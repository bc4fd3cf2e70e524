"""Array functions with 0-based positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def append(a: Column, b: Column, unique: bool = False) -> Column:
    return F.array_union(a, b) if unique else F.concat(a, b)


def position(a: Column, x) -> Column:
    """Index from 0, -1 if absent."""
    return F.array_position(a, x) - 1


def nth(a: Column, n: int) -> Column:
    """Element n from 0, null outside."""
    return F.try_element_at(a, F.lit(n + 1 if n >= 0 else n))


def first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def pop(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def push(a: Column, x, unique: bool = False) -> Column:
    x = x if isinstance(x, Column) else F.lit(x)
    return F.when(F.array_contains(a, x), a).otherwise(F.array_append(a, x)) if unique else F.array_append(a, x)


def unshift(a: Column, x) -> Column:
    return F.array_prepend(a, x)


def remove_nth(a: Column, n: int) -> Column:
    at = F.lit(n) if n >= 0 else F.size(a) + n
    return F.filter(a, lambda x, i: i != at)


def remove_value(a: Column, x) -> Column:
    return F.array_remove(a, x)


def remove_values(a: Column, b: Column) -> Column:
    """Keeps repeats of what stays."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def slice0(a: Column, start: int, length: int | None = None) -> Column:
    """From ``start``, counted from 0 or back from the end; a negative length leaves that many at the end."""
    n = F.size(a)
    begin = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    count = n - begin if length is None else (F.lit(length) if length >= 0 else n - begin + length)
    return F.slice(a, begin + 1, F.greatest(F.least(count, n - begin), F.lit(0)))


def interleave(a: Column, b: Column) -> Column:
    """a0, b0, a1, b1, ...; what is left of the longer one follows."""
    n = F.greatest(F.size(a), F.size(b))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.filter(F.array(F.struct((i <= F.size(a)).alias("k"), F.try_element_at(a, i).alias("v")), F.struct((i <= F.size(b)).alias("k"), F.try_element_at(b, i).alias("v"))), lambda s: s.k))
    return F.transform(F.flatten(pairs), lambda s: s.v)


def minus(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def outersection(a: Column, b: Column) -> Column:
    """Values of exactly one of the two."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of distinct values; two empty arrays give 1."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def count_distinct(a: Column) -> Column:
    return F.size(F.array_distinct(a))


def sorted_unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def flatten(a: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        a = F.flatten(a)
    return a


def average(a: Column) -> Column:
    """Of the non-null elements; null if there are none."""
    v = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def total(a: Column) -> Column:
    return F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x.cast("double"))


def variance(a: Column, sample: bool = False) -> Column:
    v = F.filter(a, lambda x: x.isNotNull())
    n, m = F.size(v), average(v)
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(n > (1 if sample else 0), squares / (n - 1 if sample else n))


def stddev(a: Column, sample: bool = False) -> Column:
    return F.sqrt(variance(a, sample))


def median(a: Column) -> Column:
    v = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    n = F.size(v)
    mid = (n / 2).cast("int")
    odd = F.try_element_at(v, mid + 1).cast("double")
    return F.when(n == 0, None).when(n % 2 == 1, odd).otherwise((F.try_element_at(v, mid) + F.try_element_at(v, mid + 1)) / 2.0)


def percentile(a: Column, p: float, interpolate: bool = False) -> Column:
    """By rank, or by interpolation between ranks."""
    v = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    n = F.size(v)
    if not interpolate:
        return F.when(n > 0, F.try_element_at(v, F.greatest(F.ceil(n * p / 100.0), F.lit(1)).cast("int")).cast("double"))
    at = (n + 1) * p / 100.0
    low = F.greatest(F.least(F.floor(at), n), F.lit(1)).cast("int")
    high = F.least(low + 1, n)
    part = F.when((at < 1) | (at >= n), 0.0).otherwise(at - F.floor(at))
    a_, b_ = F.try_element_at(v, low).cast("double"), F.try_element_at(v, high).cast("double")
    return F.when(n > 0, a_ + part * (b_ - a_))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequally long or zero vectors."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0)
    return F.when(F.coalesce(ok, F.lit(False)), F.try_divide(dot(a, b), n)).otherwise(0.0)


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
