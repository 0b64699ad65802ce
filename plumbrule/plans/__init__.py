"""Query plans over the given tables, one module per family."""

from __future__ import annotations

import importlib

MODULES = (
    "profiling",
    "associations",
    "exploration",
    "evaluation",
    "sequences",
    "modelling",
)


def load_queries():
    from plumbrule.plans import registry

    for name in MODULES:
        importlib.import_module(f"plumbrule.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
