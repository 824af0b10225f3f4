"""The registered queries of the engine's own operators and their SQL."""

from carrel.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
