"""The engine's queries and their SQL."""

from __future__ import annotations

from plinth.plans import documents, fields, judgments, pages, retrieval  # noqa: F401  they register their queries
from plinth.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
