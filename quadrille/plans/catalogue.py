"""Importing this module registers every query."""

from __future__ import annotations

import importlib

from quadrille.plans.registry import QUERIES

MODULES = ["pattern_queries", "aggregate_queries", "graph_queries", "quality_queries", "search_queries", "change_queries", "function_queries"]

for _name in MODULES:
    importlib.import_module(f"quadrille.plans.{_name}")

__all__ = ["QUERIES"]
