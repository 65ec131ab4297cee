"""All registered queries with their oracles."""

from __future__ import annotations

from . import alignment, cleaning, documents, factcheck, minutes, terms

_MODULES = (alignment, cleaning, factcheck, terms, minutes, documents)


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
