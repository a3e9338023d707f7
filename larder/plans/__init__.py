"""Query registry: name -> (Spark callable over a scale-factor folder, oracle SQL)."""

from larder.plans.registry import all_queries, all_oracles, comparable

__all__ = ["all_queries", "all_oracles", "comparable"]
