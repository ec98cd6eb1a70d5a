"""What the groups of queries share: a registry, and SQL for the oracles."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """Queries by name, their oracle SQL by name, and the decorator that enters them."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def sql_any(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def sql_hits(columns: tuple[str, ...], parts: tuple[str, ...]) -> str:
    return "(" + " + ".join("(" + " OR ".join(f"contains({c}, '{p}')" for c in columns) + ")::INT" for p in parts) + ")"


def sql_matches(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


def sql_count(column: str, part: str) -> str:
    return f"(len(string_split({column}, '{part}')) - 1)"
