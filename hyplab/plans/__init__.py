"""Registered queries, their derived views and their SQL oracles."""

from importlib import import_module

MODULES = (
    "sources_and_contracts", "texts", "distances", "joins", "aggregates", "windows",
    "language_models", "fusion", "gates", "resampling", "incremental",
)


def load():
    """Import every query module once and return the registry."""
    for name in MODULES:
        import_module(f"hyplab.plans.{name}")
    return import_module("hyplab.plans.registry")
