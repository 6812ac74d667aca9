"""Registered queries, one for each operator, with equivalent SQL."""

from __future__ import annotations

from . import elements, fields, language, lanes, matrices, media, whole

_ALL = (elements, lanes, matrices, media, language, fields, whole)


def queries() -> dict:
    return {k: f for m in _ALL for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _ALL for k, s in m.SQL.items()}
