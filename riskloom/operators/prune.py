"""Correlation pruning: pairs above a threshold come from Spark, greedy choices are made on that edge list of columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS


def strong_edges(corr: DataFrame, threshold: float, inclusive: bool) -> list[tuple[str, str]]:
    r = F.round(F.abs("r"), 12)
    return [(x["a"], x["b"]) for x in corr.where(r >= threshold if inclusive else r > threshold).select("a", "b").collect()]


def prune_greedy(columns: list[str], edges: Iterable[tuple[str, str]], priority: dict[str, float] | None = None, by_name: bool = False) -> tuple[list[str], list[str]]:
    """kept and dropped columns. Pairs are met in the order of the later column, then the earlier; the one of lower priority goes, of equals the earlier
    (by_name, without priorities: the later name)."""
    place = {c: i for i, c in enumerate(columns)}
    ordered = sorted((tuple(sorted(e, key=place.__getitem__)) for e in edges if e[0] in place and e[1] in place), key=lambda e: (place[e[1]], place[e[0]]))
    dropped: set[str] = set()
    for early, late in ordered:
        if early in dropped or late in dropped:
            continue
        if priority is None and by_name:
            loser = max(early, late)
        else:
            score = priority or {}
            loser = late if score.get(late, 0.0) < score.get(early, 0.0) else early
        dropped.add(loser)
    return [c for c in columns if c not in dropped], sorted(dropped)


def prune_correlated(corr: DataFrame, columns: list[str], threshold: float = DEFAULTS.correlation, priority: dict[str, float] | None = None) -> tuple[list[str], list[str]]:
    return prune_greedy(columns, strong_edges(corr, threshold, False), priority, by_name=True)


def prune_inclusive(corr: DataFrame, columns: list[str], threshold: float = DEFAULTS.correlation_inclusive, priority: dict[str, float] | None = None) -> tuple[list[str], list[str]]:
    kept, dropped = prune_greedy(columns, strong_edges(corr, threshold, True), priority)
    return sorted(kept), dropped


def redundant(corr: DataFrame, columns: list[str], threshold: float = DEFAULTS.correlation, inclusive: bool = False) -> list[str]:
    """Every column that correlates with an earlier one."""
    place = {c: i for i, c in enumerate(columns)}
    return sorted({max(e, key=place.__getitem__) for e in strong_edges(corr, threshold, inclusive) if e[0] in place and e[1] in place})


def prune_components(corr: DataFrame, columns: list[str], score: dict[str, float], threshold: float = DEFAULTS.correlation) -> tuple[list[str], list[str]]:
    """Of each connected group of columns the one with the best score stays, of equals the earliest."""
    up = {c: c for c in columns}

    def find(c: str) -> str:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    for a, b in strong_edges(corr, threshold, True):
        if a in up and b in up:
            up[find(a)] = find(b)
    best: dict[str, str] = {}
    for c in columns:
        g = find(c)
        if g not in best or score.get(c, 0.0) > score.get(best[g], 0.0):
            best[g] = c
    kept = [c for c in columns if best[find(c)] == c]
    return kept, sorted(set(columns) - set(kept))
