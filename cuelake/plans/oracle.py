"""SQL by name of query."""

from cuelake.plans.registry import oracle_sql

__all__ = ["oracle_sql"]
