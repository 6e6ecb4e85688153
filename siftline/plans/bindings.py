"""All queries that bind the engine's operators to the driver's tables."""

from __future__ import annotations

from . import queries_boxes, queries_curation, queries_detection, queries_files, queries_leakage, queries_selection  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
