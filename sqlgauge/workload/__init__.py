"""The registered queries: every operator bound to the given tables, with its check in plain SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("questions", "sqltext", "metrics", "linking", "execution", "files")


def load():
    """All queries and their checks."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
