"""Named queries over the driver tables, grouped by family."""

from __future__ import annotations

import importlib

FAMILIES = ["texts", "relevance", "lifecycles", "graphs", "reports", "extraction", "composites", "streams"]


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"engram.catalog.{family}")


def all_queries() -> dict:
    from engram.catalog.registry import QUERIES
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    from engram.catalog.registry import ORACLES
    _load()
    return dict(ORACLES)
