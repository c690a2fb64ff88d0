"""Registered queries over the test tables, each with its DuckDB twin."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    """Import every catalogue module and return the registered queries."""
    from fieldspark.catalog.registry import QUERIES

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
    return dict(QUERIES)
