"""The queries of the operators, with SQL where it can say them."""

from __future__ import annotations

from tessera.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
