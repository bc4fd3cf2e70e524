"""Value semantics of the document query language: truthiness, defaults, coercions, safe arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy_number(c: Column) -> Column:
    """null and 0 are false."""
    return F.coalesce(c != 0, F.lit(False))


def truthy_string(c: Column) -> Column:
    """null and the empty string are false."""
    return F.coalesce(c != "", F.lit(False))


def truthy_bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def truthy_array(c: Column) -> Column:
    """Arrays and objects are true, even empty ones; null is false."""
    return c.isNotNull()


def either(a: Column, b: Column, truthy: Callable[[Column], Column]) -> Column:
    """a if it is true, else b: the ``||`` default and the short ternary."""
    return F.when(truthy(a), a).otherwise(b)


def safe_div(a: Column, b: Column) -> Column:
    """Division by 0 is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def to_number(c: Column) -> Column:
    """Numeric strings to numbers, other strings and null to 0."""
    return F.coalesce(F.expr("try_cast(null as double)") if c is None else c.try_cast("double"), F.lit(0.0))


def to_bool(c: Column, kind: str) -> Column:
    return {"number": truthy_number, "string": truthy_string, "bool": truthy_bool, "array": truthy_array}[kind](c)


def not_null(*cs: Column) -> Column:
    return F.coalesce(*cs)


def less(a: Column, b: Column) -> Column:
    """Order with null below everything: null < x is true for any x that isn't null."""
    return F.when(b.isNull(), False).when(a.isNull(), True).otherwise(a < b)


def concat(*cs: Column) -> Column:
    """Concatenation that skips null."""
    return F.concat_ws("", *cs)


def min_match(n: int, *conditions: Column) -> Column:
    """Whether at least n of the conditions hold."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total >= n
