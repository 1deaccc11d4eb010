"""Queries over the sample tables; importing the package registers them all."""

from crosswise.plans import artifacts, details, queries  # noqa: F401  they register themselves
from crosswise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
