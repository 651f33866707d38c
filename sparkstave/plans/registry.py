"""All queries of the library's own operators with their SQL, gathered by module."""

from __future__ import annotations

from sparkstave.plans import corpus, io, scoring, tokens

MODULES = (corpus, scoring, tokens, io)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
