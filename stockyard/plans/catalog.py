"""All registered queries."""

from stockyard.plans import lifecycle, processing, reporting, streams  # noqa: F401
from stockyard.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
