"""Registered queries and their SQL."""

from . import layers  # noqa: F401  registers its queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
