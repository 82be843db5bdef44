"""Registered queries: each runs operators over whole given tables and has, where SQL can say it,
an equivalent DuckDB statement."""

from __future__ import annotations

from importlib import import_module

MODULES = ("market", "ratings", "form", "names", "labels", "files", "events", "metrics", "ingest", "ledger", "features", "models")


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        mod = import_module(f"cutline.catalog.{name}")
        clash = queries.keys() & mod.REGISTRY.queries.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        queries |= mod.REGISTRY.queries
        oracles |= mod.REGISTRY.oracles
    return queries, oracles
