"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import articles, documents, graphs, modules, search, symbols

PARTS = (graphs, symbols, search, documents, modules, articles)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
