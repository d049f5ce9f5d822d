"""All registered queries."""

from registry import anomalies, documents, graphs, relational  # noqa: F401 - each registers its queries
from registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
