"""Every operator as a query over the sample tables, with the SQL that checks it."""

from __future__ import annotations

from . import analytics, cleaning, feeds, filters, sides  # noqa: F401 - they register
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
