"""The registered queries on text and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

NAMES = ("tokenizer", "leakage", "spans", "pii", "near_duplicates", "listings", "boilerplate", "residue", "truncation")
MODULES = tuple(import_module(f"lodestone.llm.{n}") for n in NAMES)


def queries() -> dict[str, Callable]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
