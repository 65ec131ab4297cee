"""All queries of this package with their oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ("topk", "bpe", "secrets", "pii", "caps", "jaccard", "toxicity", "tokens", "lines", "mixing", "repair", "chat", "infill")


def _all(kind):
    out = {}
    for name in MODULES:
        out.update(getattr(import_module(f".{name}", __package__), kind, {}))
    return out


def queries():
    return _all("QUERIES")


def oracle_sql():
    return _all("ORACLE")
