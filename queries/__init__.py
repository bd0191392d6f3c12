"""Demonstration queries over the given tables, each next to its SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}

FAMILIES = ["blocking", "records", "schema", "matching", "kb", "graph", "linking"]

for _family in FAMILIES:
    _module = import_module(f"queries.{_family}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
