"""Importing this package registers every query."""

from cellscape.plans.registry import ORACLES, QUERIES
from cellscape.plans import collections, label_state, pixels, scoring, terrain  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
