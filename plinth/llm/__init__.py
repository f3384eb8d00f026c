"""Operators for preparing large training corpora.

Each module holds one operator and the query that applies it to its whole
table.  Nothing outside this package imports it.
"""

from plinth.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
