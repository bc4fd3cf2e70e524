"""Runs named steps in the order of what they need, each once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

Step = Callable[[dict[str, Any]], Any]


def order(needs: dict[str, list[str]]) -> list[str]:
    """Steps so that each comes after what it needs; names decide among those that are ready. A cycle raises."""
    left, out = {k: set(v) for k, v in needs.items()}, []
    while left:
        ready = sorted(k for k, v in left.items() if not v & left.keys())
        if not ready:
            raise ValueError(f"steps need each other: {', '.join(sorted(left))}")
        out.append(ready[0])
        del left[ready[0]]
    return out


def run(steps: dict[str, tuple[list[str], Step]], only: list[str] | None = None) -> dict[str, Any]:
    """Results by name; a step gets the results so far. ``only`` runs some steps and what they need."""
    wanted = set(only or steps)
    while True:
        more = {n for k in wanted for n in steps[k][0]} - wanted
        if not more:
            break
        wanted |= more
    done: dict[str, Any] = {}
    for name in order({k: steps[k][0] for k in wanted}):
        done[name] = steps[name][1](done)
    return done
