"""Registered queries: name -> (callable(spark, folder), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator that files a query under ``name`` with its SQL twin."""

    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def load_all() -> None:
    """Import every core query module (each registers its queries)."""
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
