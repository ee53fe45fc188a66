"""Loads every query module once."""

from __future__ import annotations

import importlib

_MODULES = ("spatial_queries", "edge_queries", "experiment_queries", "link_queries",
            "volume_queries", "block_queries", "repair_queries", "text_queries",
            "plan_queries", "sweep_queries", "apart_queries")


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"trackspark.plans.{module}")
