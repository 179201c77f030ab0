"""All registered queries."""

from __future__ import annotations

import importlib

from quaylight.plans.registry import ORACLES, QUERIES

for _part in ("q_events", "q_sources", "q_logs", "q_metrics", "q_delivery"):
    importlib.import_module(f"quaylight.plans.{_part}")

__all__ = ["ORACLES", "QUERIES"]
