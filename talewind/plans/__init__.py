"""Queries over the sample tables."""

import importlib

MODULES = ("signals", "series", "graph", "sources", "texts", "vectors", "identity", "forecasts", "lookups")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"talewind.plans.{name}")
