"""All registered queries with their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("rollups", "joins", "decisions", "texts", "scores", "streams", "records")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"tessera.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
