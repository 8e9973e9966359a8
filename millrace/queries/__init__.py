"""Queries over the given tables, each with the SQL another engine gives the same rows for."""

from __future__ import annotations

from importlib import import_module

MODULES = ("log", "messages", "registry", "access", "delivery", "model", "observe", "catalog", "landing", "streams")


def all_queries() -> dict[str, tuple]:
    """Name -> (function of session and table folder, oracle SQL or None)."""
    found: dict[str, tuple] = {}
    for module in MODULES:
        found.update(import_module(f"{__name__}.{module}").QUERIES)
    return found
