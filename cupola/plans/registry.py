"""The registered queries of the splitting engine and the DuckDB SQL that each is held against."""

from __future__ import annotations

from cupola.plans import queries
from cupola.plans.oracle import ORACLE_SQL

QUERIES = {name: getattr(queries, name) for name in queries.NAMES}

__all__ = ["ORACLE_SQL", "QUERIES"]
