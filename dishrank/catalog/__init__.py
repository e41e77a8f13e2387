"""Queries over the test tables, each with the SQL that checks it."""

from .oracles import oracle_sql
from .registry import entry, queries

__all__ = ["entry", "oracle_sql", "queries"]
