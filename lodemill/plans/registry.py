"""Queries of the engine's own operators and their SQL."""

from lodemill.plans import run_queries  # noqa: F401  adds its queries
from lodemill.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
