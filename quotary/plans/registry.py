"""All queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

import importlib

MODULES = ("matching", "audience", "timing", "catalog", "texts", "streams", "more", "assembling", "wordings", "alignments", "naming", "checks", "runs", "intake")
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"quotary.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
