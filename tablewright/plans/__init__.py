"""Queries over the supplied tables, one per operator."""

from . import columns, missing_values, documents, grouping, joining, runs, shape, sources  # noqa: F401  (they register themselves)
from .registry import ORACLE, QUERIES
