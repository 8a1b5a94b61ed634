"""All queries and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ("records", "memory")


def collect(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"memloom.queries.{name}"), kind)
    return found
