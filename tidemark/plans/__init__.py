"""Registered queries over the event adapter, each with its SQL where SQL can express it."""

from __future__ import annotations


def registered() -> dict:
    """name -> (query, DuckDB SQL or None)."""
    from tidemark.plans import core, small, statistics, tables

    return {**core.QUERIES, **statistics.QUERIES, **tables.QUERIES, **small.QUERIES}
