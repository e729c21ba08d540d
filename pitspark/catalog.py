"""All queries of the library (the training-data subpackage adds its own in __spark_entry__.py)."""

from .plans import data_queries, market_queries, system_queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data_queries", "market_queries", "system_queries"]
