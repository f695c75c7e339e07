"""Runnable queries over the standard tables, grouped by operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every catalogue module and return (queries, check SQL)."""
    from tidemark.plans import registry

    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name.startswith("catalogue_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return registry.QUERIES, registry.CHECK_SQL
