"""Query bindings, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def collect():
    """Import every binding module once and return the registry."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name != "registry":
            importlib.import_module(f"{__name__}.{info.name}")
    return registry
