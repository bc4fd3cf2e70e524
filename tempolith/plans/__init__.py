"""Named queries over the operators. Importing this package registers them all."""

from ..registry import CORE
from . import aggregates, extraction, functions, graph, linking, matching, relational, searching, sources, streams, temporal, walking
from .temporal import flagship

__all__ = ["CORE", "aggregates", "extraction", "flagship", "functions", "graph", "linking", "matching", "relational", "searching", "sources", "streams", "temporal", "walking"]
