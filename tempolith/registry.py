"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .session import ship

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    oracle: str | None
    operators: tuple[str, ...]


def _shipping(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def query(self, *operators: str, oracle: str | None = None, name: str | None = None):
        """Register a query; ``operators`` are the inventory ids that it covers."""

        def wrap(f: Query) -> Query:
            key = name or f.__name__
            if key in self.entries:
                raise ValueError(f"query {key} is registered twice")
            self.entries[key] = Entry(key, f, oracle, operators)
            return f

        return wrap

    def queries(self) -> dict[str, Query]:
        return {k: _shipping(e.run) for k, e in self.entries.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {k: e.oracle for k, e in self.entries.items() if e.oracle}


#: Queries over the engine's core operators; plan modules add to it.
CORE = Registry()
