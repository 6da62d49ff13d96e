"""The registered queries over the test tables and their DuckDB oracles.

Importing the query modules fills the registry.
"""

from __future__ import annotations

from quire.plans.registry import IDS, ORACLES, QUERIES

_MODULES = ("corpus", "training", "scoring", "logits", "tokenizer", "generation", "sources")


def _load() -> None:
    import importlib
    for m in _MODULES:
        importlib.import_module(f"quire.plans.{m}")


def all_queries():
    _load()
    return QUERIES


def all_oracles():
    _load()
    return ORACLES


def all_ids():
    _load()
    return IDS
