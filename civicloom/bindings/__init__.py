"""Queries over the driver tables, each with an independent SQL formulation."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every binding module, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
