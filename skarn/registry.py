"""All queries of the library by name, with SQL for those that SQL can express."""

from __future__ import annotations

from skarn.queries import ORACLE_SQL, QUERIES, memory, search, structure, tools

__all__ = ["ORACLE_SQL", "QUERIES", "memory", "search", "structure", "tools"]
