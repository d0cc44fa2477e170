"""Registered queries: each name with its Spark function and, where there is one, its SQL."""

from __future__ import annotations

import importlib

MODULES = ["retrieval", "catalog", "quality", "change", "responses", "sessions", "steps"]


def registry() -> dict:
    found: dict = {}
    for module in MODULES:
        for name, item in importlib.import_module(f"workload.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = item
    return found
