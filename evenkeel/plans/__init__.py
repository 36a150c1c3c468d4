"""The registered queries: every operator on the driver's tables, with the same in SQL."""

from evenkeel.plans import columns, objects, streams, tables
from evenkeel.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "columns", "objects", "streams", "tables"]
