"""Documents whose shape isn't known: JSON strings, as variants where built-in functions do, else parsed in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def typename(value: Column) -> Column:
    """null, bool, number, string, array or object: the type of a JSON value; null for what isn't JSON."""
    s = F.schema_of_variant(F.try_parse_json(value))
    kinds = F.when(s == "VOID", "null").when(s == "BOOLEAN", "bool").when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
    return F.when(s.isNull(), F.lit(None)).otherwise(kinds.otherwise("number"))


def is_type(value: Column, name: str) -> Column:
    return F.coalesce(typename(value) == name, F.lit(False))


def entries(m: Column) -> Column:
    """Pairs of a map's keys and values, by key."""
    return F.array_sort(F.map_entries(m))


def translate(value: Column, lookup: Column, default: Column | None = None) -> Column:
    """What a map has for a value; else the default, or the value itself."""
    return F.coalesce(F.try_element_at(lookup, value), value if default is None else default)


def _text(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _parsed(f: Callable, *columns: Column) -> Column:
    """``f`` of parsed documents, as JSON; null where one of them isn't an object."""
    import pandas as pd

    def one(*texts: str | None) -> str | None:
        try:
            docs = [json.loads(t) for t in texts if t is not None]
        except ValueError:
            return None
        return _text(f(*docs)) if len(docs) == len(texts) and all(isinstance(x, dict) for x in docs) else None

    if len(columns) == 1:

        @F.pandas_udf("string")
        def single(a):
            return pd.Series([one(x) for x in a], dtype=object)

        return single(*columns)

    @F.pandas_udf("string")
    def double(a, b):
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return double(*columns)


def merge_recursive(a: Column, b: Column) -> Column:
    """Two documents in one: documents inside both are merged, too; of other values the second one's counts."""

    def merged(x: dict, y: dict) -> dict:
        return x | {k: merged(x[k], v) if isinstance(x.get(k), dict) and isinstance(v, dict) else v for k, v in y.items()}

    return _parsed(merged, a, b)


def unset_recursive(a: Column, *names: str) -> Column:
    """A document without some attributes, at all depths."""

    def rest(x):
        if isinstance(x, dict):
            return {k: rest(v) for k, v in x.items() if k not in names}
        return [rest(v) for v in x] if isinstance(x, list) else x

    return _parsed(rest, a)


def keep_recursive(a: Column, *names: str) -> Column:
    """A document with some attributes only, at all depths that these lead to."""

    def some(x):
        if isinstance(x, dict):
            return {k: some(v) for k, v in x.items() if k in names}
        return [some(v) for v in x] if isinstance(x, list) else x

    return _parsed(some, a)
