"""All registered queries of the analytics part, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from loomstead.plans import corpus, evaluation, logs, sources


def _all() -> list[tuple[str, Callable, str | None]]:
    return [*corpus.ENTRIES, *evaluation.ENTRIES, *logs.ENTRIES, *sources.ENTRIES]


def queries() -> dict[str, Callable]:
    return {name: query for name, query, _ in _all()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _all() if sql}
