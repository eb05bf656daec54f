"""Operators for training data; nothing outside this package imports it."""

from cellmill.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
