"""One query per operation, over whole tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import expressions, graphs, relations, search, sequences, stores, texts, vectors
from ._registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "expressions", "graphs", "relations", "search", "sequences", "stores", "texts", "vectors"]
