"""All queries of the library over the driver's tables."""

from kinsmith.plans import linkage_queries, relational_queries, text_queries  # noqa: F401
from kinsmith.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
