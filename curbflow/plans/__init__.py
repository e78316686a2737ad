"""Registered queries over the given tables, and their SQL oracles."""

from . import cleaning, joining, learning, pricing, profiling, series, sources, spatial  # noqa: F401  they register their queries
from . import panels, training  # noqa: F401  they read the oracles of the others
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
