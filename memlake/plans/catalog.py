"""All registered queries."""

from __future__ import annotations

from memlake.plans import hierarchy, ingest, knowledge, recall, reports, texts  # noqa: F401
from memlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
