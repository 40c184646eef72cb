"""Every named query of the engine, by theme."""

from __future__ import annotations

import importlib

THEMES = ["values", "products", "records", "sources", "learning"]


def load():
    """(queries, oracles) with all themes registered."""
    from . import registry
    for theme in THEMES:
        importlib.import_module(f"{__name__}.{theme}")
    return registry.QUERIES, registry.ORACLES
