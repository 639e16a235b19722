"""The registered queries and the SQL that states the same results."""

from . import aggregates, flow, models, scalars, stats, tables  # noqa: F401  each module registers its queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
