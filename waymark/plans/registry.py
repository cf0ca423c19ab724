"""All registered queries of the library with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("spatial", "places", "text", "search", "quality", "streams", "stores")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"waymark.plans.{name}").QUERIES
    return found


def queries() -> dict:
    return {k: v[0] if isinstance(v, tuple) else v for k, v in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _all().items() if isinstance(v, tuple)}
