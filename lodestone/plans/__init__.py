"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.plans import observations, problem4, stores, texts

MODULES = (stores, observations, texts, problem4)


def queries() -> dict[str, Callable]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
