"""Registered queries: each operator run over the driver tables, with the SQL that checks it."""
from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval", "lines", "codes", "answers", "stored")


def registry() -> dict:
    """name -> (query, sql or None)"""
    found: dict = {}
    for module in MODULES:
        found.update(import_module(f"citeline.workload.{module}").QUERIES)
    return found
