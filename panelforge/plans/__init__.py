"""Multi-step plans and the query registry used by the correctness harness."""

from __future__ import annotations

import importlib
import pkgutil


def load_queries():
    """Import every ``queries_*`` module and return (queries, oracle texts)."""
    from panelforge.plans import registry

    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{mod.name}")
    return registry.QUERIES, registry.ORACLE
