"""Rows of a Spark result and of a DuckDB result in one form."""

import math


def norm(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "null"
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(norm, x)) + "]"
    if isinstance(x, dict):
        return str({k: norm(v) for k, v in x.items()})
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def same_rows(df, relation):
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns)
    assert len(a) == len(b)
    assert a == b
