"""All named queries outside the optional subpackages, with their SQL."""

from __future__ import annotations

from setloom.plans import composed, domain, relational, scalars  # noqa: F401  (importing them registers their queries)
from setloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
