"""Every named query of the library, and DuckDB SQL for the same rows."""

from __future__ import annotations

from lodestar.plans import retrieval, vectors

QUERIES = retrieval.QUERIES | vectors.QUERIES
ORACLE_SQL = retrieval.ORACLE_SQL | vectors.ORACLE_SQL
