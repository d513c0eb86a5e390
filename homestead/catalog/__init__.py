"""Registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from homestead.catalog import chance, joins, models, scalars, search, sets, stats, vectors
from homestead.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "chance", "joins", "models", "scalars", "search", "sets", "stats", "vectors"]
