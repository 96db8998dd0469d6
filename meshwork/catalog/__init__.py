"""Queries by name, each with its SQL oracle where SQL can express it."""

from meshwork.catalog import clusters, quality, requests, retrieval, temporal, textual  # noqa: F401
from meshwork.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
